"""Scope, gates, merging and listing of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("off", "warn", "error")
#: points of a changed file's parts in the focus score
FOCUS = {"fan_in": 3, "churn": 2, "complexity": 1}


def in_scope(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """findings(id, anchor, sites, owners) that a scope(file) keeps: by the anchor file where there is one, else by sites.

    sites are trimmed to the scope, and a finding without an anchor goes with its last one; owners are trimmed too, and
    a finding that has owners needs two of them left. Findings with neither stay: they are of the whole project.
    """
    files = scope.select(F.col("file").alias("__f")).distinct()
    kept = findings.join(files, F.col("anchor") == F.col("__f"), "left").withColumn("__a", F.col("__f").isNotNull()).drop("__f")
    for c in ("sites", "owners"):
        each = findings.select("id", F.explode(c).alias("__f")).distinct().join(files, "__f").groupBy("id").agg(F.array_sort(F.collect_set("__f")).alias(f"__{c}"))
        kept = kept.join(each, "id", "left")
    none = F.array().cast("array<string>")
    had = {c: F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("sites", "owners")}
    left = {c: F.coalesce(f"__{c}", none) for c in ("sites", "owners")}
    stay = F.when(F.col("anchor").isNotNull(), F.col("__a")).when(had["sites"], F.size(left["sites"]) > 0).otherwise(True)
    stay &= ~had["owners"] | (F.size(left["owners"]) >= 2)
    return kept.filter(stay).select("id", "anchor", left["sites"].alias("sites"), left["owners"].alias("owners"))


def head_minus_base(head: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) that head has more often than base, as many times as it has more."""
    return head.select(*keys).exceptAll(base.select(*keys))


def introduced_cycles(head: DataFrame, base: DataFrame) -> DataFrame:
    """(key): cycles(cycle, file) of head that base has not, known by their sorted files, wherever they begin.

    A cycle of head that is there several times gives one key; null files don't count, a cycle without files has none.
    """
    key = F.array_join(F.array_sort(F.collect_set(F.col("file").cast("string"))), "|").alias("key")
    keyed = [c.filter("file IS NOT NULL").groupBy("cycle").agg(key).select("key") for c in (head, base)]
    return keyed[0].distinct().join(keyed[1].distinct(), "key", "left_anti")


def introduced_zone_pairs(head: DataFrame, base: DataFrame) -> DataFrame:
    """(from_zone, to_zone, imports): pairs of zones that head crosses and base doesn't; a second import across a pair
    that base has is nothing new."""
    pair = ["from_zone", "to_zone"]
    return head.groupBy(*pair).agg(F.count(F.lit(1)).alias("imports")).join(base.select(*pair).distinct(), pair, "left_anti")


def bucket_overflow(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, found, allowed, over): findings of each bucket beyond those that a baseline(keys, n) allows."""
    now = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    old = baseline.groupBy(*keys).agg(F.sum("n").alias("allowed"))
    allowed = F.coalesce("allowed", F.lit(0)).cast("long")
    out = now.join(old, keys, "left").select(*keys, "found", allowed.alias("allowed"))
    return out.withColumn("over", F.greatest(F.lit(0).cast("long"), F.col("found") - F.col("allowed")))


def severity_gate(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, errors, warnings, fails): findings(rule, finding, file) by the level of rules(rule, file, level).

    A finding over several files, as a cycle is, has the highest level of them.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("level"))
    found = findings.join(rules.select("rule", "file", rank.alias("r")), ["rule", "file"]).groupBy("rule", "finding").agg(F.max("r").alias("r"))
    count = lambda n: F.count(F.when(F.col("r") == n, 1))
    return found.groupBy("rule").agg(count(3).alias("errors"), count(2).alias("warnings")).withColumn("fails", F.col("errors") > 0)


def ineffective_overrides(overrides: DataFrame, files: DataFrame, base: DataFrame) -> DataFrame:
    """(override, reason): overrides(override, prefix, rule, level) that match no files(path), or set the level that
    base(rule, level) has already."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    hit = files.filter("path <> ''").select(F.explode(prefixes).alias("prefix")).join(F.broadcast(overrides.select("prefix").distinct()), "prefix").distinct()
    unmatched = overrides.join(hit, "prefix", "left_anti").select("override", F.lit("no-file").alias("reason"))
    same = overrides.join(hit, "prefix").join(base.withColumnRenamed("level", "__l"), "rule").filter(F.col("level") == F.col("__l"))
    return unmatched.unionByName(same.select("override", F.lit("same-level").alias("reason"))).distinct()


def focus_map(files: DataFrame, cut_at: int) -> DataFrame:
    """(path, score, rank, list): files(path, fan_in, churn, complexity) by FOCUS points for each that is above zero;
    `review` from cut_at points on, else `skim`: the two lists part the files."""
    points = [F.when(F.coalesce(F.col(c), F.lit(0)) > 0, w).otherwise(0) for c, w in FOCUS.items()]
    score = (points[0] + points[1] + points[2]).cast("long")
    # ranks are counted within a score and added to how many have more: no window over all files
    found = files.select("path", score.alias("score"))
    above = found.groupBy("score").agg(F.count(F.lit(1)).alias("n"))  # at most 7 scores
    above = above.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("above"))
    own = F.row_number().over(Window.partitionBy("score").orderBy("path"))
    found = found.join(F.broadcast(above), "score").withColumn("rank", (F.col("above") + own).cast("long"))
    return found.select("path", "score", "rank", F.when(F.col("score") >= cut_at, "review").otherwise("skim").alias("list"))


def diff_risks(tests: DataFrame, suppressions: DataFrame, deps: DataFrame, clones: DataFrame, branches: DataFrame) -> DataFrame:
    """(rule, key) of what a change does, from tables with (key, base, head).

    weakened-tests: fewer assertions in tests; added-suppression and test-only-branch: more of them in a file;
    added-dependency: none before; diverged-clone-sibling: of clones(key, changed), instances of a group of which some
    but not all changed.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), F.col("key").cast("string").alias("key"))
    out = rule(tests.filter(n("head") < n("base")), "weakened-tests")
    out = out.unionByName(rule(suppressions.filter(n("head") > n("base")), "added-suppression"))
    out = out.unionByName(rule(branches.filter(n("head") > n("base")), "test-only-branch"))
    out = out.unionByName(rule(deps.filter((n("base") == 0) & (n("head") > 0)), "added-dependency"))
    some = clones.groupBy("key").agg(F.bool_or("changed").alias("a"), F.bool_and("changed").alias("b")).filter("a AND NOT b")
    return out.unionByName(rule(some, "diverged-clone-sibling")).distinct()


def merged_inventory(parts: list[DataFrame], key: list[str], sums: list[str], firsts: list[str]) -> DataFrame:
    """One row a key from the same table of several runs, in their order: `sums` are added up, of `firsts` the first
    value that isn't null wins."""
    every = None
    for i, part in enumerate(parts):
        part = part.select(*key, *sums, *firsts, F.lit(i).alias("__run"))
        every = part if every is None else every.unionByName(part)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__run"))).alias(c)
    return every.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], *[first(c) for c in firsts])


def merged_diagnostics(*parts: DataFrame) -> DataFrame:
    """(kind, path, message) of all tables, once each."""
    out = parts[0].select("kind", "path", "message")
    for part in parts[1:]:
        out = out.unionByName(part.select("kind", "path", "message"))
    return out.distinct()


def lean(findings: DataFrame, drop: list[str], order: list, top: int) -> DataFrame:
    """The first `top` findings by an order, without some columns."""
    return findings.orderBy(*order).limit(top).drop(*drop)


def finding_lookup(wanted: DataFrame, findings: DataFrame, fixed: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(id, answer) of wanted(id): found, or why it isn't there: suppressed, fixed since, or unknown."""
    mark = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    out = wanted.select("id").distinct()
    for name, df in (("found", findings), ("suppressed", suppressed), ("fixed", fixed)):
        out = out.join(mark(df, name), "id", "left")
    return out.select("id", F.when(F.col("found"), "found").when(F.col("suppressed"), "suppressed").when(F.col("fixed"), "fixed").otherwise("unknown").alias("answer"))


def entry_summary(entries: DataFrame) -> DataFrame:
    """(source, entries, paths): entry points of each source, and their different paths."""
    return entries.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("path").alias("paths"))


def inventory(**tables: DataFrame) -> DataFrame:
    """(kind, name) of tables with (name): files, entries, plugins, zones and so on."""
    out = None
    for kind, df in sorted(tables.items()):
        part = df.select(F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name")).distinct()
        out = part if out is None else out.unionByName(part)
    return out
