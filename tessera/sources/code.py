"""Source trees, manifests, history and coverage as fact tables.

Sources are read by a text scan on the JVM, not by a full parser: comments are masked first, strings are kept. What the
scan does not see (computed names, types, templates' expressions) gives no fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import matches_globs

NAME = r"[A-Za-z_$][\w$]*"
QUOTED = r"""["'`]([^"'`\n]+)["'`]"""
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script>"


def discover(spark: SparkSession, root: str, globs: list[str], ignored: list[str] = ()) -> DataFrame:
    """(path, content) of the files under root: paths relative to it, the last matching glob of `ignored` counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(globs) + "}").load(root)
    at = F.expr(f"substring(path, length(substring_index(path, '{root.strip('/')}/', 1)) + {len(root.strip('/')) + 2})")
    files = files.select(at.alias("path"), F.decode("content", "UTF-8").alias("content"))
    return files.filter(~matches_globs(F.col("path"), list(ignored)))


def scripts(content: Column, path: Column) -> Column:
    """The script of a file: of component and markup files the script blocks joined by line breaks, else the whole."""
    blocks = F.array_join(F.regexp_extract_all(content, F.lit(SCRIPT), 1), "\n")
    front = F.regexp_extract(content, r"(?s)\A\s*---\r?\n(.*?)\r?\n---", 1)
    return F.when(path.rlike(r"\.(vue|svelte|html?)$"), blocks).when(path.rlike(r"\.astro$"), F.concat_ws("\n", front, blocks)).otherwise(content)


def without_comments(code: Column) -> Column:
    """Code with comments emptied; strings that hold comment signs stay, and so do line breaks outside of comments."""
    kept = r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|/\*[\s\S]*?\*/|//[^\n]*"""
    return F.regexp_replace(F.coalesce(code, F.lit("")), kept, "$1")


def is_generated(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 400).rlike(r"(?i)@generated|do not edit|auto-?generated"), F.lit(False))


def _all(code: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(code, F.lit(pattern), group)


def facts(files: DataFrame) -> DataFrame:
    """(file, kind, name, source) of files(path, content).

    Kinds: import, type_import, side_effect, dynamic_import, require and re_export with a source; export with a name.
    """
    code = files.select(F.col("path").alias("file"), without_comments(scripts(F.col("content"), F.col("path"))).alias("code"))
    pair = lambda pattern, kind: F.transform(
        F.arrays_zip(_all(F.col("code"), pattern, 1).alias("n"), _all(F.col("code"), pattern, 2).alias("s")),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x["n"]).alias("name"), x["s"].alias("source")),
    )
    only = lambda pattern, kind: F.transform(_all(F.col("code"), pattern), lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("name"), s.alias("source")))
    named = lambda pattern: F.transform(_all(F.col("code"), pattern), lambda n: F.struct(F.lit("export").alias("kind"), n.alias("name"), F.lit(None).cast("string").alias("source")))
    lists = F.flatten(F.transform(_all(F.col("code"), r"\bexport\s*(?:type\s*)?\{([^}]*)\}(?!\s*from)"), lambda x: F.split(x, ",")))
    listed = F.transform(F.filter(lists, lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit("export").alias("kind"), F.regexp_extract(x, rf"({NAME})\s*$", 1).alias("name"), F.lit(None).cast("string").alias("source")))
    found = F.concat(
        pair(rf"""\bimport\s+(?!type\b)([\w$\s{{}},*]+?)\s*from\s*{QUOTED}""", "import"), pair(rf"""\bimport\s+type\s+([\w$\s{{}},*]+?)\s*from\s*{QUOTED}""", "type_import"),
        only(rf"\bimport\s*{QUOTED}", "side_effect"), only(rf"\bimport\s*\(\s*{QUOTED}", "dynamic_import"), only(rf"\brequire\s*\(\s*{QUOTED}\s*\)", "require"),
        pair(rf"""\bexport\s*(?:type\s*)?(\{{[^}}]*\}}|\*(?:\s*as\s+{NAME})?)\s*from\s*{QUOTED}""", "re_export"),
        named(rf"\bexport\s+(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:const\s+enum|function\*?|class|const|let|var|interface|type|enum|namespace)\s+({NAME})"),
        named(r"\bexport\s+(default)\b"), listed,
    )
    return code.select("file", F.inline_outer(found)).filter("kind IS NOT NULL")


#: constructs that add a path through a function
BRANCHES = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|\?(?![.?:])"


def branching(files: DataFrame) -> DataFrame:
    """(file, lines, branches): lines of each file, and constructs in its script that add a path."""
    code = F.regexp_replace(without_comments(scripts(F.col("content"), F.col("path"))), r"""(?s)"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", "''")
    count = F.size(F.regexp_extract_all(code, F.lit(BRANCHES), 0)).cast("long")
    text = F.coalesce("content", F.lit(""))
    rows = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.rlike(r"[^\n]\z"), 1).otherwise(0)).cast("long")
    return files.select(F.col("path").alias("file"), rows.alias("lines"), count.alias("branches"))


def markers(files: DataFrame, word: str) -> DataFrame:
    """(file, line, rule) of comments `// word-ignore-next-line rule, rule`: the line after the comment; no rule means all."""
    at = files.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    at = at.filter(F.col("text").contains(f"{word}-ignore-next-line"))
    rules = F.split(F.regexp_extract("text", rf"{word}-ignore-next-line[ \t]*([\w\-, \t]*)", 1), r"[,\s]+")
    at = at.select("file", (F.col("pos") + 2).cast("long").alias("line"), F.explode(F.when(F.size(F.array_remove(rules, "")) > 0, F.array_remove(rules, "")).otherwise(F.array(F.lit(None).cast("string")))).alias("rule"))
    return at


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(file, kind, name, version) of JSON manifests (path, content): prod, dev, peer and optional dependencies."""
    of = {"prod": "dependencies", "dev": "devDependencies", "peer": "peerDependencies", "optional": "optionalDependencies"}
    parsed = F.from_json("content", ", ".join(f"{x} map<string,string>" for x in of.values()))
    none = F.create_map().cast("map<string,string>")

    def of_kind(kind: str, field: str) -> Column:
        return F.transform(F.map_entries(F.coalesce(parsed[field], none)), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("version")))

    entries = F.flatten(F.array(*[of_kind(kind, field) for kind, field in of.items()]))
    return files.select(F.col("path").alias("file"), F.inline_outer(entries)).filter("kind IS NOT NULL")


def history(log: DataFrame) -> DataFrame:
    """(commit, ts, author, path, added, deleted) of logs (value): texts of '--hash|seconds|author' and tab-separated counts.

    One row of the input is one log as a whole; binary files have '-' and count as 0.
    """
    blocks = log.select(F.explode(F.slice(F.split("value", r"(?m)^--(?=[0-9a-f]{7,40}\|)"), 2, 1 << 30)).alias("b"))
    head = F.split(F.substring_index("b", "\n", 1), r"\|", 3)
    rows = blocks.select(head[0].alias("commit"), F.timestamp_seconds(head[1].cast("long")).alias("ts"), head[2].alias("author"), F.explode(F.slice(F.split("b", "\n"), 2, 1 << 30)).alias("r"))
    part = F.split("r", "\t")
    number = lambda i: F.coalesce(F.try_to_number(F.nullif(part[i], F.lit("-")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))
    return rows.filter(F.size(part) == 3).select("commit", "ts", "author", part[2].alias("path"), number(0).alias("added"), number(1).alias("deleted"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(commit, ts, committed, author, path, added, deleted) of logs in files, made by git log --numstat -z with the
    format '%at|%ct|%H|%aE%x00'.

    Two zero bytes end a commit, so each is a record of its own and a large log is read in splits, no commit apart.
    Commits without files have no rows; binary files have '-' and count as 0; a path may hold line breaks and tabs.
    """
    each = spark.read.text(path, lineSep="\0\0").withColumn("__r", F.split("value", "\0"))
    head = F.split(F.col("__r")[0], r"\|", 4)
    rows = each.filter(F.col("__r")[0].rlike(r"^[0-9]+\|[0-9]+\|[0-9a-f]{7,64}\|")).select(head.alias("h"), F.explode(F.slice("__r", 2, 1 << 30)).alias("r"))
    part = F.split(F.regexp_replace("r", r"^\n", ""), "\t", 3)
    number = lambda i: F.coalesce(F.expr("try_cast(nullif(p[%d], '-') AS bigint)" % i), F.lit(0).cast("long"))
    at = lambda i: F.timestamp_seconds(F.col("h")[i].cast("long"))
    rows = rows.withColumn("p", part).filter(F.size("p") == 3)
    return rows.select(F.col("h")[2].alias("commit"), at(0).alias("ts"), at(1).alias("committed"), F.col("h")[3].alias("author"), F.col("p")[2].alias("path"), number(0).alias("added"), number(1).alias("deleted"))


def coverage(reports: DataFrame) -> DataFrame:
    """(path, statements, covered) of coverage reports (value): JSON objects of path -> {s: {id: count}}."""
    files = F.from_json("value", "map<string, struct<s: map<string, bigint>>>")
    each = reports.select(F.explode(files).alias("path", "f")).select("path", F.map_values("f.s").alias("n"))
    hit = F.size(F.filter("n", lambda x: x > 0))
    return each.groupBy("path").agg(F.max(F.size("n")).cast("long").alias("statements"), F.max(hit).cast("long").alias("covered"))
