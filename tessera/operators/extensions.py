"""What users add as tables: plugins, rule packs, config layers; and limits of what is looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut

#: roles of a plugin's patterns that keep a file, and the roles that credit a name
FILE_ROLES, NAME_ROLES = ("entry", "config", "always-used"), ("used-export", "used-member", "tooling-dependency")


def active_plugins(enablers: DataFrame, packages: DataFrame) -> DataFrame:
    """(plugin) with an enabler(plugin, package) among packages(package); `*` at its end stands for any rest."""
    exact = enablers.filter(~F.col("package").endswith("*")).join(packages.select("package").distinct(), "package").select("plugin")
    heads = F.transform(F.sequence(F.lit(1), F.length("package")), lambda n: F.concat(F.substring(F.col("package"), F.lit(1), n), F.lit("*")))
    open_ended = packages.select(F.explode(heads).alias("package")).distinct().join(enablers, "package").select("plugin")
    return exact.unionByName(open_ended).distinct()


def plugin_credits(rules: DataFrame, active: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, key, role): what the rules(plugin, role, pattern) of active(plugin) keep: the files(path) that a pattern, a
    regular expression, matches, and the names that the others give."""
    on = rules.join(active.select("plugin"), "plugin")
    hit = files.select("path").distinct().join(F.broadcast(on.filter(F.col("role").isin(*FILE_ROLES)).select("role", "pattern").distinct()), F.expr("rlike(path, pattern)"))
    names = on.filter(F.col("role").isin(*NAME_ROLES)).select(F.lit("name").alias("kind"), F.col("pattern").alias("key"), "role")
    return hit.select(F.lit("file").alias("kind"), F.col("path").alias("key"), "role").unionByName(names).distinct()


def layered_config(layers: DataFrame) -> DataFrame:
    """(key, value, source) of layers(source, rank, key, value): the value of the highest rank that sets the key."""
    set_ = layers.filter("value IS NOT NULL")
    return set_.groupBy("key").agg(F.max_by(F.struct("value", "source"), F.struct("rank", "source")).alias("v")).select("key", "v.value", "v.source")


def gated_rules(findings: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """findings(rule, ...) with `level` of rules(rule, enabled, level): those of disabled rules or level off go; a rule
    that has no row, or no level, has the default."""
    named = rules.groupBy("rule").agg(F.bool_and(F.coalesce("enabled", F.lit(True))).alias("__on"), F.max("level").alias("__l"))
    out = findings.join(named, "rule", "left").withColumn("level", F.coalesce("__l", F.lit(default)))
    return out.filter(F.coalesce("__on", F.lit(True)) & (F.col("level") != "off")).drop("__on", "__l")


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each one in the order of columns; rows alike in these share theirs.

    Rows are dealt out by ranges of the order and written, as ranges may be drawn anew if a task is lost. Each range is
    summed on its own and goes on from the sum of those before it: one window has a row a range, no task has more. Nulls
    of the order come first, null values count as 0.
    """
    dealt = cut(df.withColumn("__v", F.coalesce(value, F.lit(0))).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    ranges = dealt.groupBy("__p").agg(F.sum("__v").alias("__s"))
    before = ranges.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__b"))
    inside = F.sum("__v").over(Window.partitionBy("__p").orderBy(*order))
    return dealt.join(before, "__p").withColumn(name, inside + F.col("__b")).drop("__p", "__v", "__b")


def limited_functions(functions: DataFrame, least_lines: int, most_bytes: int, budget: int) -> DataFrame:
    """(fn, reason): null for functions(fn, path, lines, bytes) that are taken, else why not: too short, too large, or
    beyond the budget of bytes, which is spent by path and function."""
    reason = F.when(F.col("lines") < least_lines, "too-short").when(F.col("bytes") > most_bytes, "too-large")
    own = functions.withColumn("reason", reason)
    taken = F.when(F.col("reason").isNull(), F.col("bytes")).otherwise(0)
    out = running_sum(own, ["path", "fn"], taken, "spent")
    return out.select("fn", F.coalesce("reason", F.when(F.col("spent") > budget, "over-budget")).alias("reason"))


def pairs_in_scope(pairs: DataFrame, scope: DataFrame) -> DataFrame:
    """pairs(a, b) with an end in scope(id)."""
    ids = scope.select("id").distinct()
    one = lambda c: pairs.join(ids.withColumnRenamed("id", c), c, "left_semi").select(*pairs.columns)
    return one("a").unionByName(one("b")).distinct()


def flag_inventory(reads: DataFrame) -> DataFrame:
    """(key, kinds, reads, first_site) of flag reads(site, kind, key), kinds such as env, sdk and config sorted and joined."""
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), ",")
    return reads.filter("key IS NOT NULL").groupBy("key").agg(kinds.alias("kinds"), F.count(F.lit(1)).alias("reads"), F.min("site").alias("first_site"))


def flag_keys(reads: DataFrame, registry: DataFrame) -> DataFrame:
    """(site, key): reads(site, path) of a flag by its member path in a registry(path, key); a path that the registry
    lacks, or has for several keys, gives null."""
    single = registry.groupBy("path").agg(F.countDistinct("key").alias("n"), F.min("key").alias("key")).filter("n = 1").drop("n")
    return reads.join(single, "path", "left").select("site", "key")


def runner_reach(mutants: DataFrame, reached: DataFrame) -> DataFrame:
    """(mutant, tests): for mutants(mutant, file) the tests that reach the file by reached(test, file); 0 for none."""
    n = reached.groupBy("file").agg(F.countDistinct("test").alias("tests"))
    return mutants.join(n, "file", "left").select("mutant", F.coalesce("tests", F.lit(0)).cast("long").alias("tests"))


def class_shaped(text: Column) -> Column:
    """Distinct lower-case words with hyphens, of two signs or more and one letter at least, without hyphens at the ends."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[a-z0-9\-]+"), 0), lambda x: F.regexp_replace(x, "^-+|-+$", ""))
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) >= 2) & x.rlike("[a-z]")))


def utility_classes(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(name, namespace) of class names(name) that a utility of prefixes(prefix, namespace) makes: after variants with
    colons, a minus and an exclamation mark, the longest prefix before a hyphen, or the whole name."""
    bare = F.regexp_replace(F.regexp_replace("name", r"^(?:[a-z0-9\-\[\]/@]+:)+", ""), "^[!-]", "")
    parts = F.split("bare", "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    each = names.select("name").distinct().withColumn("bare", bare).select("name", F.explode(heads).alias("prefix"))
    return each.join(F.broadcast(prefixes), "prefix").groupBy("name").agg(F.max_by("namespace", F.length("prefix")).alias("namespace"))


def variant_drift(variants: DataFrame, tokens: DataFrame) -> DataFrame:
    """(variant, token) of variants(variant, token) whose token no theme, tokens(token), defines."""
    return variants.select("variant", "token").distinct().join(tokens.select("token").distinct(), "token", "left_anti").select("variant", "token")


def packages_with(manifests: DataFrame, prefixes: list[str]) -> DataFrame:
    """(file) of manifests(file, name) with a dependency that begins with one of the prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("name").startswith(p)
    return manifests.filter(hit).select("file").distinct()
