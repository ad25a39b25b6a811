"""Style analytics: class tokens of markup against classes of style sheets, theme tokens, repeated blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_tokens(markup: Column) -> Column:
    """Distinct static class names of class and className attributes."""
    lists = F.regexp_extract_all(markup, F.lit(r"""\bclass(?:Name)?=["']([^"'{}$<>]*)["']"""), 1)
    return F.array_distinct(F.array_remove(F.flatten(F.transform(lists, lambda x: F.split(x, "[ \t\r\n\f]+"))), ""))


def has_dynamic_classes(markup: Column) -> Column:
    return F.coalesce(markup.rlike(r"""\bclass(Name)?=(\{|["'][^"']*(\{\{|\$\{))|:class=|classList\."""), F.lit(False))


def defined_classes(sheet: Column) -> Column:
    """Distinct class selectors of a style sheet; comments, strings, urls and numbers give none."""
    bare = F.regexp_replace(sheet, r"""(?s)/\*.*?\*/|"[^"]*"|'[^']*'|url\([^)]*\)|\{[^{}]*\}""", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\.(-?[A-Za-z_][A-Za-z0-9_-]*)"), 1))


def style_blocks(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit("(?is)<style[^>]*>(.*?)</style>"), 1)


def class_findings(used: DataFrame, defined: DataFrame) -> DataFrame:
    """(name, side) of used(name, dynamic) and defined(name): unresolved without a definition, unreferenced without a use.

    While any markup builds classes at run time, no class is called unreferenced.
    """
    abstain = not used.filter("dynamic").isEmpty()
    u, d = used.filter("name IS NOT NULL").select("name").distinct(), defined.select("name").distinct()
    no_use = d.join(u, "name", "left_anti").limit(0) if abstain else d.join(u, "name", "left_anti")
    return u.join(d, "name", "left_anti").select("name", F.lit("unresolved").alias("side")).unionByName(no_use.select("name", F.lit("unreferenced").alias("side")))


def theme_tokens(sheets: DataFrame, key: str, sheet: str) -> DataFrame:
    """(token, definitions, uses): custom properties, and how often var() reads them."""
    made = sheets.select(key, F.explode_outer(F.regexp_extract_all(sheet, F.lit(r"(?:^|[{;\s])(--[A-Za-z0-9_-]+)\s*:"), 1)).alias("token"), F.lit(1).alias("d"), F.lit(0).alias("u"))
    read = sheets.select(key, F.explode_outer(F.regexp_extract_all(sheet, F.lit(r"var\(\s*(--[A-Za-z0-9_-]+)"), 1)).alias("token"), F.lit(0).alias("d"), F.lit(1).alias("u"))
    return made.unionByName(read).filter("token IS NOT NULL").groupBy("token").agg(F.sum("d").alias("definitions"), F.sum("u").alias("uses"))


def repeated_blocks(blocks: DataFrame, key: str, block: str) -> DataFrame:
    """(block, owners, instances) of blocks that stand twice or more."""
    n = blocks.groupBy(block).agg(F.countDistinct(key).alias("owners"), F.count(F.lit(1)).alias("instances"))
    return n.filter("instances >= 2")
