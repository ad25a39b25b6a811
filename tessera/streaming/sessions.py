"""Reruns after quiet times, history by window and path, the newest version of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import cut, update_reach
from ..sources.generations import Generations


def quiet_runs(events: DataFrame, quiet: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """(start, end, key, events): bursts of events(ts, key) that end with a quiet time: one rerun each. Stream or table."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "key").agg(F.count(F.lit(1)).alias("events"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "events")


def churn_windows(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, path, commits, lines) of events(ts, path, lines) by tumbling windows; rows later than the watermark go."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "path").agg(F.count(F.lit(1)).alias("commits"), F.sum("lines").alias("lines"))
    return w.select(F.col("w.start").alias("start"), "path", "commits", "lines")


def newest(results: DataFrame, versions: DataFrame) -> DataFrame:
    """results(key, version, ...) of the newest version of each key in versions(key, version); results of others are stale."""
    top = versions.groupBy("key").agg(F.max("version").alias("version"))
    return results.join(top, ["key", "version"], "left_semi")


def upsert(path: str, keys: list[str], order: str):
    """A function for foreachBatch: keeps one Parquet row a key under `path`, the one with the highest `order`.

    Each batch writes a new folder and then moves the pointer, a file naming it, so a failed batch leaves the state whole,
    and a batch that is given again changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(conf)
        done = sorted(int(s.getPath().getName()[2:]) for s in (fs.listStatus(root) if fs.exists(root) else []) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        if batch_id in done:
            return
        every = batch if not done else spark.read.parquet(f"{path}/v={done[-1]}").unionByName(batch)
        rest = [c for c in batch.columns if c not in keys]
        best = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")
        best.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        for old in done[:-1]:  # the last one stays for readers that have begun
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}"), True)

    return write


def keep_reached(state: Generations, roots: DataFrame):
    """A function for foreachBatch over edits(seq, src, dst, there): keeps what roots(node) reach as edges come and go.

    The state holds the tables `edges` and `reached`, replaced together. Of a batch's edits of one edge the last counts;
    only what a changed edge bears on is computed again. A batch that is given again changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        at = state.newest()
        if at and at["notes"].get("batch", -1) >= batch_id:
            return
        had = state.read() or {"edges": batch.select("src", "dst").limit(0), "reached": roots.select("node").distinct()}
        last = cut(batch.groupBy("src", "dst").agg(F.max_by("there", "seq").alias("there")))
        edges = had["edges"].join(last, ["src", "dst"], "left_anti").unionByName(last.filter("there").select("src", "dst"))
        edges = cut(edges.distinct())
        reached = update_reach(edges, had["reached"], roots, last.filter("there"), last.filter("NOT there"))
        state.commit({"edges": edges, "reached": reached}, batch=batch_id)

    return apply
