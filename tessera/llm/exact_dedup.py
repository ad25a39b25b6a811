"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New data is reduced to digests, deduplicated in itself by a combined aggregate, then against the index by a
sort-merge anti-join on the bucketed digest; what is new is appended to the index. Only digests are shuffled,
never texts, so the cost of the shuffle is about 100 bytes a row however long the texts are. Digests of a large share
of all rows are looked up by broadcast, so that no task gets all copies of one text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, documents

#: batches that a whole table is added in, by ranges of ids
BATCHES = 3
#: rows of a bucket, about, of a new index, and the least and the most buckets
BUCKET_ROWS, BUCKETS = 1_000_000, (24, 50_000)
#: digests that at least one in so many rows has are broadcast; there are no more than this many
HOT = 200


def digest(text):
    """Hex SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " "), 256)


def digests(batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return batch.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text_sha256"))


class DigestIndex:
    """Table of (text_sha256, keep_id): every accepted text once, in sorted buckets. It stays until drop().

    Rows accepted earlier win over later batches. Within a batch the smallest id wins; a null id loses to any
    other. Rows that repeat both id and text share one decision. An empty batch changes nothing. Columns other
    than the two named are ignored, so clashing names do no harm.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS[0]):
        self.spark, self.name = spark, name
        self.buckets = self._own_buckets() if self.exists() else buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _own_buckets(self) -> int:
        said = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
        return int(said["Num Buckets"])

    def _write(self, rows: DataFrame, name: str) -> None:
        rows = rows.select("text_sha256", "keep_id").repartition(self.buckets, "text_sha256")
        rows.write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append").saveAsTable(name)

    def append(self, rows: DataFrame) -> None:
        """Appends the texts of rows(id, text_sha256) that the index doesn't have: a sort-merge anti-join on the buckets."""
        fresh = rows.groupBy("text_sha256").agg(F.min("id").alias("keep_id"))
        if self.exists():
            fresh = fresh.join(self.spark.table(self.name).hint("merge"), "text_sha256", "left_anti")
        self._write(fresh, self.name)

    def decide(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """(id, keep_id, group_size, kept, text_sha256) of rows(id, text_sha256), all of them in the index.

        group_size counts the rows given that have the text; copies that only earlier calls saw don't count.
        """
        sizes = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
        groups = scratch.save(sizes.join(self.spark.table(self.name).hint("merge"), "text_sha256"), "groups")
        total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        hot = groups.filter(F.col("group_size") * HOT >= total)
        hot = hot.select("text_sha256", F.struct("keep_id", "group_size").alias("hot"))
        marked = rows.join(F.broadcast(hot), "text_sha256", "left")
        busy = marked.filter("hot IS NOT NULL").select("id", "hot.keep_id", "hot.group_size", "text_sha256")
        rest = marked.filter("hot IS NULL").drop("hot").join(groups.hint("merge"), "text_sha256")
        out = busy.unionByName(rest.select("id", "keep_id", "group_size", "text_sha256"))
        return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

    def add(self, batch: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Appends the batch's new texts and decides on every row of it."""
        rows = scratch.save(digests(batch, id_col, text_col), f"digests-{uuid.uuid4().hex}")
        self.append(rows)
        return self.decide(rows, scratch)

    def compact(self) -> None:
        """One file a bucket again, after many appends."""
        spare = f"{self.name}_{uuid.uuid4().hex}"
        self._write(self.spark.table(self.name), spare)
        self.drop()
        self.spark.sql(f"ALTER TABLE {spare} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(spark: SparkSession, docs: DataFrame, name: str | None = None, batches: int = BATCHES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs(doc_id, text).

    The rows are added to the index in batches of rising ids, null ids in the last one, so that of equal texts the
    smallest id is accepted. name: an index that persists, whose texts win over those of docs; without it the index
    is new and dropped again. Null texts count as empty, however long texts are only their digests are kept, rows
    that repeat id and text share a decision, an empty table gives no rows, and other columns are not read.
    """
    scratch = Scratch(spark, "exact")
    rows = scratch.save(digests(docs), "digests")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()
    cuts = sorted(set(found["cuts"] or []))
    index = DigestIndex(spark, name or f"tessera_digests_{uuid.uuid4().hex}", min(max(BUCKETS[0], found["n"] // BUCKET_ROWS), BUCKETS[1]))
    try:
        for low, high in zip([None, *cuts], [*cuts, None]):
            part = rows if low is None else rows.filter(F.col("id").isNull() | (F.col("id") > low))
            index.append(part if high is None else part.filter(F.col("id") <= high))
        return scratch.save(index.decide(rows, scratch).withColumnRenamed("id", "doc_id"), "result")
    finally:
        if not name:
            index.drop()


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for every document, by an index that its batches are added to in turn."""
    return exact_dedup(spark, documents(spark, sf_dir))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g USING (h)
"""
