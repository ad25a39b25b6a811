"""Set algebra over findings: baselines, differences, suppression, gates, grouping and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lots import lots
from ..functions.text import matches_globs

LEVELS = ("low", "medium", "high")


def in_diff(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """findings(path, line, ...) on a line of ranges(path, first, last); those without a path stay, without a line if the file is touched.

    Findings and ranges of a file are ordered together, a range by its first line: a line is in one if one of those that
    began before it reaches so far. Findings without a line come last, behind all ranges.
    """
    told = "path IS NOT NULL"
    each = findings.filter(told).select("path", F.col("line").alias("at"), F.lit(None).cast(ranges.schema["last"].dataType).alias("last"), F.struct(*findings.columns).alias("f"))
    spans = ranges.filter(told).select("path", F.col("first").alias("at"), "last", F.lit(None).cast(each.schema["f"].dataType).alias("f"))
    so_far = Window.partitionBy("path").orderBy(F.asc_nulls_last("at"), F.col("f").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = lots(each.unionByName(spans), "path").withColumns({"reach": F.max("last").over(so_far), "touched": F.bool_or(F.col("f").isNull()).over(so_far)})
    hit = seen.filter("f IS NOT NULL AND if(f.line IS NULL, touched, reach >= f.line)").select("f.*")
    return hit.unionByName(findings.filter("path IS NULL")).select(*findings.columns)


def groups_in_diff(instances: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """(group) of instances(group, path, first, last) one of which at least overlaps a line of ranges(path, first, last):
    a group stays whole. An instance without a path can't be told and keeps its group."""
    cells = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("__bin")
    told = "path IS NOT NULL AND first <= last"
    added = ranges.filter(told).select("path", cells, F.col("first").alias("__a"), F.col("last").alias("__b"))
    each = instances.filter(told).select("group", "path", "first", "last", cells)
    near = (each["path"] == added["path"]) & (each["__bin"] == added["__bin"]) & (F.col("first") <= F.col("__b")) & (F.col("__a") <= F.col("last"))
    return each.join(added, near, "left_semi").select("group").unionByName(instances.filter("path IS NULL").select("group")).distinct()


def baseline_slots(findings: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """New findings by key(s) and level after greedy use of the baseline's slots.

    Both sides have a key and a severity of LEVELS. The lowest level is served first; a finding uses slots of its own
    level, then of higher ones. Result: key, and new_low, new_medium, new_high, each the findings without a slot.
    """
    count = lambda df, p: df.groupBy(key).agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(f"{p}{i}") for i, s in enumerate(LEVELS)])
    j = count(findings, "f").join(count(base, "s"), key, "left").na.fill(0)
    for i in range(3):
        for k in range(i, 3):
            used = F.least(f"f{i}", f"s{k}")
            j = j.withColumns({f"f{i}": F.col(f"f{i}") - used, f"s{k}": F.col(f"s{k}") - used})
    return j.select(key, *[F.col(f"f{i}").alias(f"new_{s}") for i, s in enumerate(LEVELS)])


def moved(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, base_path, head_path): findings gone from one path and new on another with equal keys, one to one in order."""
    side = lambda df, new: df.select(*keys, "path", F.lit(new).alias("new"))
    every = lots(side(base, False).unionByName(side(head, True)).na.drop(subset=keys), *keys)
    each = every.groupBy(*keys, "path").agg(F.bool_or("new").alias("in_head"), F.bool_and("new").alias("not_in_base"))
    # a path without a name equals no other, so it is gone and new; else rows of both sides are neither
    sides = F.array(F.when(~F.col("in_head") | (F.col("path").isNull() & ~F.col("not_in_base")), False), F.when(F.col("not_in_base") | (F.col("path").isNull() & F.col("in_head")), True))
    told = each.select(*keys, "path", F.explode(F.array_compact(sides)).alias("new"))
    told = told.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "new").orderBy("path")))
    of = lambda new: F.max(F.when(F.col("new") == new, F.col("path")))
    pairs = told.groupBy(*keys, "r").agg(of(False).alias("base_path"), of(True).alias("head_path"), F.count(F.lit(1)).alias("n"))
    return pairs.filter("n = 2").drop("r", "n")


def loans(buckets: DataFrame) -> DataFrame:
    """buckets(file, category, name, anonymous, slots, found) that are over-full, with what unused anonymous slots lend.

    The unused slots of a file's anonymous buckets of a category go to its named ones in order of name; `excess` is
    what stays over.
    """
    spare = buckets.filter("anonymous").groupBy("file", "category").agg(F.sum(F.greatest(F.col("slots") - F.col("found"), F.lit(0))).alias("spare"))
    over = buckets.filter("NOT anonymous AND found > slots").withColumn("over", F.col("found") - F.col("slots"))
    w = Window.partitionBy("file", "category").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    over = over.withColumn("before", F.sum("over").over(w) - F.col("over")).join(spare, ["file", "category"], "left")
    lent = F.least("over", F.greatest(F.coalesce("spare", F.lit(0)) - F.col("before"), F.lit(0)))
    return over.select("file", "category", "name", lent.cast("long").alias("lent"), (F.col("over") - lent).cast("long").alias("excess"))


def within_tolerance(base: DataFrame, head: DataFrame, key: str, percent: float) -> DataFrame:
    """(key, base, head, allowed, regressed) of counts n: the allowance is floored, and 0 for a baseline of 0."""
    j = base.select(key, F.col("n").alias("base")).join(head.select(key, F.col("n").alias("head")), key, "full_outer").na.fill(0, ["base", "head"])
    j = j.withColumn("allowed", F.floor(F.col("base") * percent / 100).cast("long"))
    return j.withColumn("regressed", F.col("head") - F.col("base") > F.col("allowed"))


def stale_markers(markers: DataFrame, findings: DataFrame) -> DataFrame:
    """markers(file, line, rule) that hide nothing; a null line covers the file, a null rule every rule."""
    f = findings.select("file", "line", "rule").distinct()
    live = [
        markers.filter(f"line IS {'NOT ' if at else ''}NULL AND rule IS {'NOT ' if rule else ''}NULL")
        .join(f.select(*["file", *["line"] * at, *["rule"] * rule]).distinct(), ["file", *["line"] * at, *["rule"] * rule], "left_anti")
        for at in (0, 1) for rule in (0, 1)
    ]
    out = live[0].select(*markers.columns)
    for part in live[1:]:
        out = out.unionByName(part.select(*markers.columns))
    return out


def ignore(findings: DataFrame, column: str, entries: list[str]) -> tuple[DataFrame, DataFrame]:
    """Findings whose column no entry (a glob) matches, and (entry, used) for each entry: how many it matched."""
    spark = findings.sparkSession
    hit = [matches_globs(F.col(column), [e]) for e in entries]
    kept = findings.filter(~F.coalesce(matches_globs(F.col(column), entries), F.lit(False)))
    counts = findings.agg(*[F.count(F.when(h, 1)).alias(f"e{i}") for i, h in enumerate(hit)] or [F.count(F.lit(1)).alias("n")])
    rows = F.array(*[F.struct(F.lit(e).alias("entry"), F.col(f"e{i}").alias("used")) for i, e in enumerate(entries)])
    return kept, counts.select(F.inline(rows)) if entries else spark.createDataFrame([], "entry string, used long")


def merge(*parts: DataFrame) -> DataFrame:
    """All findings once, columns by name; missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.distinct()


def grouped_counts(findings: DataFrame, group: Column, unowned: str = "(unowned)") -> DataFrame:
    """(section, n, place): sections by count, then by name, the unowned one last."""
    n = findings.groupBy(F.coalesce(group, F.lit(unowned)).alias("section")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("section") == unowned, F.desc("n"), "section")  # one row a section
    return n.withColumn("place", F.row_number().over(w).cast("long"))


def code_owners(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(path, owner) by rules (glob, owner) in the order of the file: the last one that matches counts, null without any."""
    owner = F.lit(None).cast("string")
    for glob, name in rules:
        owner = F.when(matches_globs(F.col("path"), [glob]), F.lit(name)).otherwise(owner)
    return paths.select("path", owner.alias("owner"))


def effective_thresholds(units: DataFrame, inline: DataFrame, override: DataFrame, common: int, key: str, group: str) -> DataFrame:
    """units with `ceiling` and `layer`: an inline ceiling by key, else an override by group, else the common one."""
    j = units.join(inline.select(key, F.col("ceiling").alias("i")), key, "left").join(override.select(group, F.col("ceiling").alias("o")), group, "left")
    layer = F.when(F.col("i").isNotNull(), "inline").when(F.col("o").isNotNull(), "override").otherwise("global")
    return j.withColumns({"ceiling": F.coalesce("i", "o", F.lit(common)), "layer": layer}).drop("i", "o")


def verdicts(candidates: DataFrame, said: DataFrame) -> DataFrame:
    """candidates(candidate_id, review_key) with the verdict of said(candidate_id, review_key, verdict).

    By candidate_id first; else by review_key, if that key has one candidate and one verdict.
    """
    direct = said.groupBy("candidate_id").agg(F.min("verdict").alias("a"))
    once = said.groupBy("review_key").agg(F.min("verdict").alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    alone = candidates.groupBy("review_key").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("review_key")
    j = candidates.join(direct, "candidate_id", "left").join(once.join(alone, "review_key", "left_semi"), "review_key", "left")
    return j.select(*candidates.columns, F.coalesce("a", "b").alias("verdict"))


def flag_retirement(reads: DataFrame, vendor: DataFrame, as_of: str, days: int) -> DataFrame:
    """(flag, reads, reasons) of reads(flag, ts) and vendor(flag, state): both sides, reasons joined by commas."""
    used = reads.groupBy("flag").agg(F.count(F.lit(1)).alias("reads"), F.min("ts").alias("since"))
    j = used.join(vendor.select("flag", "state").withColumn("known", F.lit(True)), "flag", "full_outer")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("since").cast("date"))
    reasons = F.concat_ws(
        ",",
        F.when(F.col("known").isNull(), "not in vendor"), F.when(F.col("reads").isNull(), "not in code"), F.when(F.col("state") == "archived", "archived"),
        F.when(F.col("reads") == 1, "single read"), F.when(age >= days, "old"),
    )
    return j.select("flag", F.coalesce("reads", F.lit(0)).alias("reads"), reasons.alias("reasons"))


def sort_key(findings: DataFrame) -> DataFrame:
    """findings(severity, value, path, line, name) from most to least severe, then by place."""
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("severity"))
    return findings.orderBy(F.desc(level), F.desc("value"), "path", "line", "name")


def report_rows(findings: DataFrame, form: str) -> DataFrame:
    """(row) of findings(rule, severity, path, line, message): sarif, codeclimate, compact, markdown, annotation or json."""
    c, text = F.col, lambda x: F.col(x).cast("string")
    spot = F.struct(F.struct(F.struct(c("path").alias("uri")).alias("artifactLocation"), F.struct(c("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    level = F.when(c("severity") == "high", "error").when(c("severity") == "medium", "warning").otherwise("note")
    print_id = F.sha2(F.concat_ws("|", "rule", "path", "message"), 256)
    rank = F.when(c("severity") == "high", "critical").when(c("severity") == "medium", "major").otherwise("minor")
    forms = {
        "json": F.to_json(F.struct("rule", "severity", "path", "line", "message")),
        "sarif": F.to_json(F.struct(c("rule").alias("ruleId"), level.alias("level"), F.struct(c("message").alias("text")).alias("message"), F.array(spot).alias("locations"))),
        "codeclimate": F.to_json(F.struct(
            c("message").alias("description"), c("rule").alias("check_name"), print_id.alias("fingerprint"), rank.alias("severity"),
            F.struct(c("path"), F.struct(c("line").alias("begin")).alias("lines")).alias("location"),
        )),
        "compact": F.concat_ws(":", "path", text("line"), "rule", "message"),
        "markdown": F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(F.coalesce(text(x), F.lit("")), r"([|\\])", r"\\$1") for x in ("rule", "path", "line", "message")]), F.lit(" |")),
        "annotation": F.concat(F.lit("::"), level, F.lit(" file="), c("path"), F.lit(",line="), text("line"), F.lit("::"), c("message")),
    }
    return findings.select(forms[form].alias("row"))
