"""Manifests with comments, workspaces, histories that grow, caches and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import matches_globs
from ..operators.resolution import folder


def plain_json(text: Column) -> Column:
    """JSON of a text with comments and trailing commas; both stay inside strings."""
    kept = r"""("(?:\\.|[^"\\])*")|/\*[\s\S]*?\*/|//[^\n]*"""
    return F.regexp_replace(F.regexp_replace(text, kept, "$1"), r"""("(?:\\.|[^"\\])*")|,(?=\s*[}\]])""", "$1")


def key_values(files: DataFrame) -> DataFrame:
    """(file, section, key, value) of TOML-like texts (path, content): `key = value` lines under `[section]` lines, quotes
    of simple strings taken off; comments, arrays over several lines and nested tables in braces stay as they are written."""
    rows = files.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\r?\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", r"""^((?:[^#"']|"[^"]*"|'[^']*')*)#.*$""", "$1")))
    from pyspark.sql.window import Window

    section = F.when(F.col("line").rlike(r"^\[{1,2}[^\[\]]+\]{1,2}$"), F.regexp_replace("line", r"^\[+\s*|\s*\]+$", ""))
    seen = F.last(section, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))
    rows = rows.withColumn("section", F.coalesce(seen, F.lit(""))).filter(F.col("line").rlike(r"""^[\w."'-]+\s*="""))
    key, value = F.regexp_extract("line", r"""^([\w."'-]+)\s*=\s*(.*)$""", 1), F.regexp_extract("line", r"""^([\w."'-]+)\s*=\s*(.*)$""", 2)
    bare = lambda c: F.regexp_replace(c, r"""^(["'])(.*)\1$""", "$2")
    return rows.select("file", "section", bare(key).alias("key"), bare(value).alias("value"))


def indented_values(files: DataFrame) -> DataFrame:
    """(file, path, value) of YAML-like texts (path, content): scalars and list items under the keys above them by indent.

    Keys are joined by dots; a list item has its list's path. Flow collections, anchors and blocks of text stay as written.
    """
    line = F.regexp_replace("line", r"\s+#.*$|^#.*$", "")
    depth = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    item = F.regexp_extract("line", r"^\s*-\s+(.*)$", 1)
    key = F.regexp_extract("line", r"""^\s*(?:-\s+)?["']?([\w.@/*-]+)["']?\s*:(?:\s|$)""", 1)
    value = F.when(key != "", F.regexp_extract("line", r"""^\s*(?:-\s+)?["']?[\w.@/*-]+["']?\s*:\s*(.*)$""", 1)).otherwise(item)
    rows = F.transform(F.filter(F.split("content", "\r?\n"), lambda x: F.regexp_replace(x, r"#.*$", "").rlike(r"\S")), lambda x: x)
    rows = files.select(F.col("path").alias("file"), F.posexplode(rows).alias("pos", "line")).withColumn("line", line).filter("line <> ''")
    rows = rows.select("file", "pos", depth.alias("depth"), key.alias("key"), F.trim(value).alias("value"))
    from pyspark.sql.window import Window

    before = F.collect_list(F.struct("depth", "key")).over(Window.partitionBy("file").orderBy("pos"))
    step = lambda a, x: F.when(x["key"] == "", a).otherwise(F.concat(F.filter(a, lambda y: y["depth"] < x["depth"]), F.array(x)))
    stack = F.aggregate("before", F.array().cast("array<struct<depth:int,key:string>>"), step)
    rows = rows.withColumn("before", before).withColumn("path", F.array_join(F.transform(stack, lambda x: x["key"]), "."))
    return rows.filter("value <> ''").select("file", "path", F.regexp_replace("value", r"""^(["'])(.*)\1$""", "$2").alias("value"))


def deno_imports(files: DataFrame) -> DataFrame:
    """(file, name, target, package) of Deno manifests (path, content): entries of `imports`; package: the npm or jsr
    package that a target names, without its version."""
    parsed = F.from_json(plain_json(F.col("content")), "imports map<string,string>, workspace array<string>")
    each = files.select(F.col("path").alias("file"), F.explode(F.map_entries(parsed["imports"])).alias("e")).select("file", F.col("e.key").alias("name"), F.col("e.value").alias("target"))
    return each.withColumn("package", F.nullif(F.regexp_extract("target", r"^(?:npm|jsr):/?(@[^/@]+/[^/@]+|[^/@]+)", 1), F.lit("")))


def workspaces(manifests: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two tables of manifests(path): (root, declared) of the folders with a manifest, whether the last matching pattern
    (with ! for exceptions) takes them in; and (pattern) of those that match no folder."""
    roots = manifests.select(folder(F.col("path")).alias("root")).distinct().filter("root <> ''")
    declared = roots.withColumn("declared", matches_globs(F.col("root"), patterns))
    hits = [roots.filter(matches_globs(F.col("root"), [p])).select(F.lit(p).alias("pattern")).limit(1) for p in patterns if not p.startswith("!")]
    every = manifests.sparkSession.createDataFrame([(p,) for p in patterns if not p.startswith("!")], "pattern string")
    for hit in hits:
        every = every.join(hit, "pattern", "left_anti")
    return declared, every


def linked_dependencies(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """(workspace, name, root): dependencies deps(workspace, name, version) that link to a package of the project, by
    workspace:, link: or file:, or by the name of packages(name, root) with any version."""
    own = deps.join(packages, "name").select("workspace", "name", "root")
    path = F.nullif(F.regexp_extract("version", r"^(?:link|file):(.+)$", 1), F.lit(""))
    from ..operators.resolution import normalise

    linked = deps.withColumn("root", normalise(F.concat_ws("/", "workspace", path))).filter(path.isNotNull()).select("workspace", "name", "root")
    return own.unionByName(linked).distinct()


def extended_history(saved: DataFrame, new: DataFrame) -> DataFrame:
    """saved(commit, path, ts, ...) and the rows of new whose commit it hasn't: a cached history and a later range."""
    return saved.unionByName(new.join(saved.select("commit").distinct(), "commit", "left_anti"))


def imported_history(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON events (value): commit, path, timestamp in seconds, author, added, deleted. A row without
    commit, path or time, or with counts below 0, is an error with its reason; missing counts are 0."""
    e = F.from_json("value", "commit string, path string, timestamp bigint, author string, added bigint, deleted bigint")
    rows = events.select("value", e.alias("e"))
    reason = F.when(F.col("e.commit").isNull(), "no commit").when(F.col("e.path").isNull(), "no path").when(F.col("e.timestamp").isNull(), "no time")
    reason = reason.when((F.coalesce("e.added", F.lit(0)) < 0) | (F.coalesce("e.deleted", F.lit(0)) < 0), "negative count")
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason IS NULL").select("e.commit", "e.path", F.timestamp_seconds("e.timestamp").alias("ts"), "e.author", F.coalesce("e.added", F.lit(0)).alias("added"), F.coalesce("e.deleted", F.lit(0)).alias("deleted"))
    return good, rows.filter("reason IS NOT NULL").select("value", "reason")


class FactCache:
    """Facts by content: Parquet tables in folders named after a version, which any change of the scan must change."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.path = spark, f"{folder}/{version}"

    def load(self) -> DataFrame | None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return self.spark.read.parquet(self.path) if path.getFileSystem(conf).exists(path) else None

    def facts(self, files: DataFrame, scan) -> DataFrame:
        """scan(files) with facts (file, ...) of files(path, content): known contents are read, others scanned and kept.

        All or nothing: a version's folder counts once it is whole. Each content is scanned once, whatever its paths.
        """
        keyed = files.withColumn("sha", F.sha2(F.coalesce("content", F.lit("")), 256))
        known = self.load()
        fresh = keyed if known is None else keyed.join(known.select("sha").distinct(), "sha", "left_anti")
        some = fresh.groupBy("sha").agg(F.first("content").alias("content"))
        found = scan(some.select(F.col("sha").alias("path"), "content")).withColumnRenamed("file", "sha")
        bare = some.select("sha").join(found.select("sha").distinct(), "sha", "left_anti")
        found.unionByName(bare, allowMissingColumns=True).write.mode("append").parquet(self.path)
        out = keyed.select(F.col("path").alias("file"), "sha").join(self.spark.read.parquet(self.path), "sha").drop("sha")
        facts = [c for c in out.columns if c != "file"]
        return out.filter(" OR ".join(f"`{c}` IS NOT NULL" for c in facts))


def save_snapshot(signs: DataFrame, folder: str, run: str, at: str, version: int) -> None:
    """Appends vital signs, one row and any number of numeric columns, as (metric, value, version, at) under run=<run>."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in signs.columns])).alias("x")
    out = signs.select(pairs).select("x.*", F.lit(version).alias("version"), F.lit(at).cast("timestamp").alias("at"), F.lit(run).alias("run"))
    out.write.mode("append").partitionBy("run").parquet(folder)


def saved_report(reports: DataFrame) -> DataFrame:
    """(rule, path, line, message) of saved reports (value): JSON objects with `findings`; no rows of a text that is none."""
    f = F.from_json("value", "findings array<struct<rule string, path string, line bigint, message string>>")
    return reports.select(F.inline(f["findings"]))


def map_payload(files: DataFrame, edges: DataFrame, cycles: DataFrame, most: int) -> DataFrame:
    """(part, json): the parts of a map, of files(path, size) the `most` largest, and the edges(src, dst) and
    cycles(cycle) between these; each part is one JSON array."""
    top = files.orderBy(F.desc("size"), "path").limit(most)
    inside = edges.join(F.broadcast(top.select(F.col("path").alias("src"))), "src").join(F.broadcast(top.select(F.col("path").alias("dst"))), "dst")
    part = lambda df, name, cols: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).alias("json")).select(F.lit(name).alias("part"), "json")
    out = part(top, "files", ["path", "size"]).unionByName(part(inside.distinct(), "edges", ["src", "dst"]))
    return out.unionByName(part(cycles.distinct(), "cycles", ["cycle"]))
