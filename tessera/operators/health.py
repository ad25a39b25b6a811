"""Scores of files and functions, gates, trends and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: weights of the health score: points taken off at the full share of each
PENALTIES = {"dead_percent": 0.25, "duplicated_percent": 0.25, "complex_percent": 0.3, "cycle_percent": 0.2}
#: least score of each grade
GRADES = (("A", 90), ("B", 75), ("C", 60), ("D", 40))


def complexity_units(parts: DataFrame) -> DataFrame:
    """(fn, cyclomatic, cognitive) of contributions parts(fn, metric, weight): sums by metric, 0 where there is none."""
    total = lambda name: F.sum(F.when(F.col("metric") == name, F.col("weight")).otherwise(0)).alias(name)
    return parts.groupBy("fn").agg(total("cyclomatic"), total("cognitive"))


def gated_cyclomatic(functions: DataFrame, parts: DataFrame, policy: str) -> DataFrame:
    """(fn, cyclomatic, standard): functions(fn, cyclomatic) under a policy; standard only where the policy changed it.

    literal-membership takes off the weights of parts(fn, weight, membership) that are membership chains, down to 1.
    """
    if policy == "standard":
        return functions.select("fn", "cyclomatic", F.lit(None).cast("long").alias("standard"))
    chain = parts.filter("membership").groupBy("fn").agg(F.sum("weight").alias("w"))
    gated = F.greatest(F.lit(1), F.col("cyclomatic") - F.coalesce("w", F.lit(0)))
    gated = F.when(F.col("cyclomatic") < 1, F.col("cyclomatic")).otherwise(gated).cast("long")
    found = functions.join(chain, "fn", "left").select("fn", gated.alias("gated"), "cyclomatic")
    return found.select("fn", F.col("gated").alias("cyclomatic"), F.when(F.col("gated") != F.col("cyclomatic"), F.col("cyclomatic")).alias("standard"))


def finding_order() -> list[Column]:
    """Order of health findings: priority, severity, CRAP, cyclomatic, cognitive, lines downwards; then path, line, column, name."""
    down = ["priority", "severity", "has_crap", "cyclomatic", "cognitive", "lines"]
    return [F.col(c).desc() for c in down] + [F.col(c).asc() for c in ("path", "line", "col", "name")]


def file_scores(functions: DataFrame, churn: DataFrame) -> DataFrame:
    """(file, functions, cyclomatic, worst, commits, maintainability) of functions(file, cyclomatic, lines) and churn(file).

    Maintainability, 0 to 100, is defined here: 100 less 2 for each branch point of the average function above one, and
    less a tenth of its average length.
    """
    per = functions.groupBy("file").agg(F.count(F.lit(1)).alias("functions"), F.sum("cyclomatic").alias("cyclomatic"), F.max("cyclomatic").alias("worst"), F.sum("lines").alias("lines"))
    commits = churn.groupBy("file").agg(F.count(F.lit(1)).alias("commits"))
    score = 100 - 2 * (F.col("cyclomatic") / F.col("functions") - 1) - F.col("lines") / F.col("functions") / 10
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1)
    out = per.join(commits, "file", "left")
    return out.select("file", "functions", "cyclomatic", "worst", F.coalesce("commits", F.lit(0)).cast("long").alias("commits"), score.alias("maintainability"))


def long_files(files: DataFrame, most: int) -> DataFrame:
    """(file, lines, over) of files(file, lines) with more than `most` lines."""
    return files.filter(F.col("lines") > most).select("file", "lines", (F.col("lines") - most).alias("over"))


def large_functions(functions: DataFrame, ceiling: int, very_high: int, share: float = 3.0) -> DataFrame:
    """functions(fn, lines, synthetic) above the ceiling, if at least `share` percent of all are above `very_high`.

    Synthetic units of whole modules count for neither.
    """
    own = functions.filter("NOT synthetic")
    risk = own.agg(F.coalesce(100 * F.avg((F.col("lines") > very_high).cast("int")), F.lit(0.0)).alias("risk")).first()["risk"]
    return own.filter((F.col("lines") > ceiling) & F.lit(risk >= share)).select("fn", "lines")


def component_rollup(classes: DataFrame, templates: DataFrame) -> DataFrame:
    """(component, class_complexity, template_complexity, total): sums of both tables (component, complexity)."""
    every = classes.select("component", F.col("complexity").alias("a"), F.lit(0).alias("b")).unionByName(templates.select("component", F.lit(0).alias("a"), F.col("complexity").alias("b")))
    out = every.groupBy("component").agg(F.sum("a").cast("long").alias("class_complexity"), F.sum("b").cast("long").alias("template_complexity"))
    return out.withColumn("total", F.col("class_complexity") + F.col("template_complexity"))


def vital_signs(functions: DataFrame, group: list[str] = []) -> DataFrame:  # noqa: B006
    """(group, functions, p50, p90, complex_percent, long_percent) of functions(group, cyclomatic, lines).

    Percentiles by nearest rank; complex: above 10, long: above 60; both to one decimal. Without a group one row.
    """
    order = Window.partitionBy(*group).orderBy("cyclomatic")
    counts = functions.groupBy(*group, "cyclomatic").agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("lines") > 60).cast("int")).alias("long"))
    counts = counts.withColumns({"upto": F.sum("c").over(order), "all": F.sum("c").over(Window.partitionBy(*group))})
    rank = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("cyclomatic")))
    share = lambda x: F.round(100 * F.coalesce(x, F.lit(0)) / F.sum("c"), 1)
    return counts.groupBy(*group).agg(
        F.sum("c").alias("functions"), rank(0.5).alias("p50"), rank(0.9).alias("p90"),
        share(F.sum(F.when(F.col("cyclomatic") > 10, F.col("c")))).alias("complex_percent"), share(F.sum("long")).alias("long_percent"),
    )


def health_score(signs: DataFrame) -> DataFrame:
    """signs with score and grade: 100 less PENALTIES times the percentages, of those that the table has."""
    points = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in PENALTIES.items() if c in signs.columns]
    score = F.round(F.greatest(F.lit(0.0), reduce(lambda a, b: a - b, points, F.lit(100.0))), 1)
    grade = F.lit("F")
    for name, least in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return signs.withColumn("score", score).withColumn("grade", grade)


def most_rendered(sites: DataFrame, most: int = 20) -> DataFrame:
    """(component, path, parents, sites): the components of sites(component, path, parent) with most parents, then most
    sites, then by path and name."""
    found = sites.groupBy("component", "path").agg(F.countDistinct("parent").alias("parents"), F.count(F.lit(1)).alias("sites"))
    return found.orderBy(F.desc("parents"), F.desc("sites"), "path", "component").limit(most)


def trends(snapshots: DataFrame) -> DataFrame:
    """(run, metric, previous, value, delta, direction) of snapshots(run, at, metric, value, version): each against the
    one before; none where the version of the formula differs or there is none before."""
    order = Window.partitionBy("metric").orderBy("at", "run")
    found = snapshots.withColumns({"previous": F.lag("value").over(order), "had": F.lag("version").over(order)}).filter("had = version AND previous IS NOT NULL")
    delta = F.col("value") - F.col("previous")
    return found.select("run", "metric", "previous", "value", delta.alias("delta"), F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat").alias("direction"))


def coverage_gaps(files: DataFrame, exports: DataFrame, reached: DataFrame, tested: DataFrame, unused: DataFrame) -> DataFrame:
    """(kind, key): runtime files(file) that no test reaches by reached(file), and value exports(export, file, is_type)
    that none uses by tested(export); those already reported in unused(export) are left out."""
    f = files.select("file").distinct().join(reached.select("file").distinct(), "file", "left_anti")
    e = exports.filter("NOT is_type").join(tested.select("export").distinct(), "export", "left_anti").join(unused.select("export").distinct(), "export", "left_anti")
    return f.select(F.lit("file").alias("kind"), F.col("file").cast("string").alias("key")).unionByName(e.select(F.lit("export").alias("kind"), F.col("export").cast("string").alias("key")))


def change_dispersion(changes: DataFrame) -> DataFrame:
    """(file, files, lines): medians over the commits of a file of how many files and lines they change."""
    commits = changes.groupBy("commit").agg(F.countDistinct("file").alias("files"), F.sum("lines").alias("lines"))
    per = changes.select("commit", "file").distinct().join(commits, "commit").groupBy("file")
    return per.agg(F.median("files").alias("files"), F.median("lines").alias("lines"))


def owner_reach(changed: DataFrame, closure: DataFrame, owners: DataFrame) -> DataFrame:
    """(group, direct, reached): owner groups of the changed(file), and those only in the closure(file), by files."""
    flag = changed.select("file").distinct().withColumn("direct", F.lit(True)).unionByName(closure.select("file").distinct().withColumn("direct", F.lit(False)))
    flag = flag.groupBy("file").agg(F.bool_or("direct").alias("direct"))
    count = lambda c: F.count(F.when(c, 1))
    return flag.join(owners.select("file", "group"), "file").groupBy("group").agg(count(F.col("direct")).alias("direct"), count(~F.col("direct")).alias("reached"))


def coverage_verdicts(signals: DataFrame) -> DataFrame:
    """(key, verdict, action) of signals(key, used, hits, tested, complex): the first that fits.

    Run and untested: at risk, or gap if simple; run and tested: healthy; never run: dead if unused, idle if tested,
    else unproven.
    """
    hit, no = F.coalesce(F.col("hits"), F.lit(0)) > 0, F.lit(False)
    tested, hard, used = (F.coalesce(F.col(c), no) for c in ("tested", "complex", "used"))
    verdict = F.when(hit & ~tested & hard, "at-risk").when(hit & ~tested, "gap").when(hit, "healthy").when(~used, "dead").when(tested, "idle").otherwise("unproven")
    action = F.when(F.col("verdict").isin("at-risk", "gap"), "add-tests").when(F.col("verdict") == "dead", "remove").when(F.col("verdict").isin("idle", "unproven"), "review").otherwise("keep")
    return signals.select("key", verdict.alias("verdict")).withColumn("action", action)


def runtime_rows(rows: DataFrame, baseline: DataFrame, changed: DataFrame | None, top: int) -> DataFrame:
    """rows(key, file, hits) that aren't in baseline(key), of changed(file) if given, the `top` by hits and key."""
    left = rows.join(baseline.select("key").distinct(), "key", "left_anti")
    left = left if changed is None else left.join(changed.select("file").distinct(), "file", "left_semi")
    return left.orderBy(F.desc("hits"), "key").limit(top)


def detector_availability(detectors: DataFrame, packages: DataFrame) -> DataFrame:
    """(detector, status, packages): active if one of the packages that it needs, detectors(detector, package), is there."""
    have = packages.select("package").distinct().withColumn("have", F.lit(1))
    found = detectors.select("detector", "package").distinct().join(have, "package", "left").groupBy("detector").agg(F.count("have").alias("packages"))
    return found.select("detector", F.when(F.col("packages") > 0, "active").otherwise("no-package").alias("status"), "packages")


def over_threshold(functions: DataFrame, ceilings: DataFrame, default: int) -> DataFrame:
    """(fn, cyclomatic, ceiling) of functions(fn, path, cyclomatic) above their ceilings(path, ceiling), or the default:
    the marks that an editor shows, by the rule of the report."""
    own = ceilings.groupBy("path").agg(F.min("ceiling").alias("c"))
    out = functions.join(own, "path", "left").select("fn", "cyclomatic", F.coalesce("c", F.lit(default)).cast("long").alias("ceiling"))
    return out.filter("cyclomatic > ceiling")
