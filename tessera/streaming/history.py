"""Incremental history: append-only event streams, counted by day with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(day, event_type, n) of a stream or table of events(ts, event_type); rows later than the watermark are dropped."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n")


def changed_rows(before: DataFrame, now: DataFrame) -> DataFrame:
    """Rows to publish: those of now that were not there before, as many times as they are new."""
    return now.exceptAll(before)
