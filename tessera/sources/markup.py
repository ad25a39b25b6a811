"""Facts of templates, queries and style sheets, by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), group)


def without_templates(content: Column) -> Column:
    """Script of a file with <template> blocks in it: the blocks become blanks of their length, line breaks stay."""
    return F.array_join(F.transform(F.split(F.regexp_replace(content, r"(?s)(<template\b[^>]*>.*?</template>)", "\u0001$1\u0001"), "\u0001"), lambda x: F.when(x.startswith("<template"), F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), "")


def template_components(files: DataFrame) -> DataFrame:
    """(file, component) of files(path, content): tags of <template> blocks that name a component, by a capital letter."""
    blocks = F.array_join(_all(F.col("content"), r"(?s)<template\b[^>]*>(.*?)</template>"), "\n")
    return files.select(F.col("path").alias("file"), F.explode(F.array_distinct(_all(blocks, r"<([A-Z][A-Za-z0-9]*(?:(?:\.|::)[A-Za-z0-9]+)*)"))).alias("component"))


def query_imports(files: DataFrame) -> DataFrame:
    """(file, source) of query documents (path, content): comments that begin with the word import and a quoted relative
    path. A quote that isn't closed on its line, an empty path or a name of something else than a file gives nothing."""
    bare = lambda c: F.btrim(c, F.lit(" \t\r"))
    lines = files.select(F.col("path").alias("file"), F.explode(F.split("content", "\n")).alias("line")).select("file", bare(F.col("line")).alias("line")).filter("startswith(line, '#')")
    said = lines.select("file", bare(F.expr("substring(line, 2)")).alias("said")).filter("startswith(said, 'import')")
    after = said.select("file", F.expr("substring(said, 7)").alias("rest")).filter(F.substring("rest", 1, 1).isin(" ", "\t")).select("file", bare(F.col("rest")).alias("rest"))
    sign = F.substring("rest", 1, 1)
    closed = after.filter(sign.isin("'", '"') & F.expr("instr(substring(rest, 2), left(rest, 1)) > 0"))
    source = F.split_part("rest", sign, F.lit(2))
    return closed.select("file", source.alias("source")).filter("startswith(source, './') OR startswith(source, '../')").distinct()


def sheet_references(files: DataFrame) -> DataFrame:
    """(file, kind, name, source) of style sheets (path, content): `import`s and `url()`s with their source, and names that
    `composes` takes, with a source where it names one. Comments count for nothing."""
    code = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)/\*.*?\*/", " ")
    none = F.lit(None).cast("string")
    one = lambda kind, pattern: F.transform(_all(code, pattern), lambda s: F.struct(F.lit(kind).alias("kind"), none.alias("name"), s.alias("source")))
    pattern = r"""composes\s*:\s*([\w\-\s]+?)(?:\s+from\s+["']([^"']+)["'])?\s*[;}]"""
    both = F.arrays_zip(_all(code, pattern, 1).alias("n"), _all(code, pattern, 2).alias("s"))
    composed = F.flatten(F.transform(both, lambda x: F.transform(F.split(F.trim(x["n"]), r"\s+"), lambda n: F.struct(F.lit("composes").alias("kind"), n.alias("name"), F.nullif(x["s"], F.lit("")).alias("source")))))
    found = F.concat(one("import", r"""@(?:import|use|forward)\s+(?:url\(\s*)?["']([^"']+)["']"""), one("url", r"""(?<!@import )url\(\s*["']?((?!data:)[^"')\s]+)["']?\s*\)"""), composed)
    return files.select(F.col("path").alias("file"), F.inline(found)).distinct()


def script_classes(files: DataFrame) -> DataFrame:
    """(file, name, dynamic) of scripts (path, content): class names that scripts add, remove, toggle or assign by literals;
    dynamic where a script gives a class list anything but literals."""
    calls = _all(F.col("content"), r"\.classList\.(?:add|remove|toggle|contains|replace)\(([^()]*)\)")
    names = F.flatten(F.transform(calls, lambda x: F.regexp_extract_all(x, F.lit(r"""["'`]([\w\-]+)["'`]"""), 1)))
    assigned = F.flatten(F.transform(_all(F.col("content"), r"""\.className\s*=\s*["']([^"'\n]*)["']"""), lambda x: F.split(F.trim(x), r"\s+")))
    loose = F.exists(calls, lambda x: F.regexp_replace(x, r"""["'`][\w\-]+["'`]|\btrue\b|\bfalse\b|[\s,]""", "") != "") | F.coalesce(F.col("content").rlike(r"""\.className\s*=\s*[^"'\s=]"""), F.lit(False))
    found = F.array_remove(F.array_distinct(F.concat(names, assigned)), "")
    return files.select(F.col("path").alias("file"), F.explode_outer(found).alias("name"), loose.alias("dynamic")).filter("name IS NOT NULL OR dynamic")


def styles_in_script(files: DataFrame) -> DataFrame:
    """(file, sheet): template literals of styled.tag, css, keyframes and createGlobalStyle in scripts (path, content)."""
    pattern = r"(?s)\b(?:styled(?:\.\w+|\([\w.\"']+\))|css|keyframes|createGlobalStyle)\s*`([^`]*)`"
    return files.select(F.col("path").alias("file"), F.explode(_all(F.col("content"), pattern)).alias("sheet"))
