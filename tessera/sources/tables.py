"""Reading the driver's tables, and the fact views that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    """(doc_id, pos, line) of lines longer than `least` characters: all but the empty ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    return docs.filter(F.length("line") > least).withColumn("pos", F.col("pos").cast("long"))


LINES_SQL = """lines AS (SELECT doc_id, pos, x[pos + 1] AS line FROM (
  SELECT doc_id, x, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE length(x[pos + 1]) > 0)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): users of error events and the key in their properties; keys are below 100, so the cycles stay among as many nodes."""
    e = read(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst")).distinct()


CALLS_SQL = """edges AS (SELECT DISTINCT user_id AS src, json_extract_string(props, '$.k')::BIGINT AS dst FROM events WHERE event_type = 'error')"""
