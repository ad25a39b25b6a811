"""Mutants: sites from a replacement table, pattern rewrites, ids, widening of changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: operator, token, replacement
REPLACEMENTS = [
    ("arithmetic", "+", "-"), ("arithmetic", "-", "+"), ("arithmetic", "*", "/"), ("arithmetic", "/", "*"),
    ("boundary", "<", "<="), ("boundary", "<=", "<"), ("boundary", ">", ">="), ("boundary", ">=", ">"),
    ("equality", "===", "!=="), ("equality", "!==", "==="), ("equality", "==", "!="), ("equality", "!=", "=="),
    ("logical", "&&", "||"), ("logical", "||", "&&"), ("logical", "??", "&&"), ("boolean", "true", "false"), ("boolean", "false", "true"),
    ("update", "++", "--"), ("update", "--", "++"),
]


def replacement_table(spark, rows=REPLACEMENTS) -> DataFrame:
    return spark.createDataFrame(rows, "operator string, token string, replacement string")


def mutants(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """(file, pos, operator, token, replacement, mutant_id) of tokens(file, pos, token); the id is a hash of all but the token."""
    found = tokens.select("file", "pos", "token").join(table, "token")
    ident = F.sha2(F.concat_ws("|", "file", "pos", "operator", "replacement"), 256)
    return found.select("file", "pos", "operator", "token", "replacement", ident.alias("mutant_id"))


def pattern_mutants(pattern: Column) -> Column:
    """Array of rewrites of a regular expression that differ from it: anchors, quantifiers, classes."""
    rewrites = [
        F.regexp_replace(pattern, r"^\^", ""), F.regexp_replace(pattern, r"(?<!\\)\$$", ""), F.regexp_replace(pattern, r"(?<!\\)\+", "*"),
        F.regexp_replace(pattern, r"(?<!\\)\*", "+"), F.regexp_replace(pattern, r"\\d", r"\\D"), F.regexp_replace(pattern, r"\\w", r"\\W"),
        F.when(pattern.rlike(r"\[\^"), F.regexp_replace(pattern, r"\[\^", "[")).otherwise(F.regexp_replace(pattern, r"(?<!\\)\[", "[^")),
    ]
    return F.array_distinct(F.filter(F.array(*rewrites), lambda x: x != pattern))


def widen(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """functions(file, name, first, last) that hold one of lines(file, line): the next line from their first one on is not
    behind their last one. Lines and functions are ordered together by file, once."""
    each = functions.filter("file IS NOT NULL AND first IS NOT NULL").distinct()
    each = each.select("file", F.col("first").alias("at"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"), F.struct(*functions.columns).alias("f"))
    every = each.unionByName(lines.filter("file IS NOT NULL AND line IS NOT NULL").select("file", F.col("line").alias("at"), "line"), allowMissingColumns=True)
    w = Window.partitionBy("file").orderBy(F.desc("at"), F.col("f").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("next", F.last("line", ignorenulls=True).over(w))
    return found.filter("f IS NOT NULL AND next <= f.last").select("f.*")


def hinted(mutants_: DataFrame, hints: DataFrame, width: int = 64) -> DataFrame:
    """mutants(file, line, ...) with the smallest hint of hints(file, first, last, hint) that covers their line, else null,
    by bins of lines."""
    cells = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width)))
    points = mutants_.select("file", "line").distinct().withColumn("bin", F.floor(F.col("line") / width))
    found = points.join(hints.withColumn("bin", cells), ["file", "bin"]).filter("line BETWEEN first AND last")
    found = found.groupBy("file", "line").agg(F.min("hint").alias("hint"))
    return mutants_.join(found, ["file", "line"], "left").select(*mutants_.columns, "hint")
