"""Helpers shared by the corpus operators: tables, scratch storage, Arrow text access, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: white space of the contracts: space and the five ASCII controls 0x09 to 0x0D
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: rows of a batch that goes to Python, where the session doesn't say
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: internal id of rows whose doc_id is null: they come after every other document
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python by BATCH_ROWS, so that both sides hold little at once; a session that names a number keeps it."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode a private one where that is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Intermediate tables, written once as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs the tasks of one step, not of the whole job. The tables of a lazy result
    must stay until it is read; release() deletes the folders of steps whose results have been written elsewhere.
    """

    made: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append((spark, self.root))
        small_batches(spark)

    @staticmethod
    def release(since: int) -> None:
        """Deletes the folders made after the first `since` ones."""
        for spark, root in Scratch.made[since:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del Scratch.made[since:]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of finished steps."""
        self.spark._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch in one array, and the offsets of each; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Cuts a batch so that each part holds about `limit` bytes of text, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b); component is the smallest node.

    Alternating large-star and small-star steps: each round is two shuffles of the edges, star centres are
    taken by a min aggregate, and no group is collected. A hot node's rows pass through partial aggregation.
    """
    edges = scratch.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    state, n = None, 0
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        n += 1
        new = scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{n}")
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{n - 1}")
        edges = new
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def spread_join(rows: DataFrame, values: DataFrame, key: str, size: str | None = None, how: str = "inner", few: int = 50_000, hot: int = 200) -> DataFrame:
    """Join (inner or left) of `rows` to `values`, whose `key` is unique, so that no task gets all rows of a frequent key.

    `few` values at most are broadcast. Of more, those are whose key at least one row in `hot` has, of which there can't be
    more than `hot`; the rest meets by a sort-merge join. size: a column of `values` with the number of rows of the key,
    which is counted without it. Both inputs are read more than once, so they should be written tables. Null keys meet
    nothing.
    """
    if values.count() <= few:
        return rows.join(F.broadcast(values), key, how)
    if size:
        total = values.agg(F.sum(size)).first()[0]
        found = values.filter(F.col(size) * hot >= total)
    else:
        total = rows.count()
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * hot >= total)
        found = values.join(F.broadcast(sizes.select(key)), key, "left_semi")
    found = found.select(key, F.struct(*[c for c in values.columns if c != key]).alias("__hot"))
    marked = rows.join(F.broadcast(found), key, "left")
    busy = marked.filter("__hot IS NOT NULL").select(*rows.columns, "__hot.*")
    rest = marked.filter("__hot IS NULL").drop("__hot").join(values.hint("merge"), key, how)
    return busy.unionByName(rest.select(*busy.columns))
