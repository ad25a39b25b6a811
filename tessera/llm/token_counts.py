"""Token counts by a persistent cache, keyed by digests of the content and of the tokenizer's version.

Documents are reduced to digests of their normalised content, which are joined to the counts stored for the same
tokenizer version. Only distinct contents without a count are encoded; their counts are appended to the cache, and every
row gets its number from there. Texts are shuffled once at most, each distinct one of a task once, and not at all where
what is missing is little enough to be broadcast.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, slices, spread_join

#: tokens from which on a text is over the limit of a context
LIMIT = 4096
#: contents of a bucket, about, of a new cache, and the least and the most buckets
BUCKET_ROWS, BUCKETS = 1_000_000, (24, 50_000)
#: digests (64 characters each) that are broadcast to find the texts to encode; beyond that the texts are shuffled to them
BROADCAST_MISSES = 50_000


def whole(text: Column) -> Column:
    """The content as it is, null as empty. Any other normalisation must keep the tokenizer's ids."""
    return F.coalesce(text, F.lit(""))


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it: counts of one version never serve another."""
    if path.endswith(".model"):
        import sentencepiece as library
    elif path.endswith(".json"):
        import tokenizers as library
    else:
        raise ValueError(f"a tokenizer is a .json or a .model file: {path}")
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Function from texts to their numbers of ids, by the library of the file's kind.

    No begin, end or added special tokens, neither truncation nor padding; strings of special tokens in a text are
    treated as the library does by default.
    """
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch(texts, add_special_tokens=False)]


class TokenCache:
    """Table of (text_sha256, n_tokens, version): one part a tokenizer version, in buckets sorted by digest.

    It stays until drop(). Two writers may append the same content at once, as they'd append the same number: readers take
    each content once.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS[0]):
        self.spark, self.name = spark, name
        self.buckets = self._own_buckets() if self.exists() else buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _own_buckets(self) -> int:
        said = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
        return int(said["Num Buckets"])

    def counts(self, version: str) -> DataFrame:
        """(text_sha256, n_tokens) of a version, each content once; the buckets serve the grouping."""
        if not self.exists():
            return self.spark.createDataFrame([], "text_sha256 string, n_tokens long")
        found = self.spark.table(self.name).filter(F.col("version") == version)
        return found.groupBy("text_sha256").agg(F.min("n_tokens").alias("n_tokens"))

    def misses(self, rows: DataFrame, version: str) -> DataFrame:
        """Distinct text_sha256 of rows without a count: a sort-merge anti-join on the buckets."""
        asked = rows.select("text_sha256").distinct()
        return asked.join(self.counts(version).hint("merge"), "text_sha256", "left_anti")

    def append(self, counted: DataFrame, version: str) -> None:
        rows = counted.select("text_sha256", "n_tokens", F.lit(version).alias("version")).repartition(self.buckets, "text_sha256")
        rows = rows.write.partitionBy("version").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
        rows.mode("append").saveAsTable(self.name)

    def versions(self) -> DataFrame:
        """(version, contents) of all that is stored."""
        return self.spark.table(self.name).groupBy("version").agg(F.count_distinct("text_sha256").alias("contents"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def encode_counts(texts: DataFrame, path: str, version: str) -> DataFrame:
    """(text_sha256, n_tokens) of texts(text_sha256, content); a task whose tokenizer is of another version fails."""

    def run(batches):
        if tokenizer_version(path) != version:
            raise ValueError(f"{path} differs between the driver and an executor")
        count = counter(path)
        for batch in batches:
            for part in slices(batch, "content"):
                found = count(part.column("content").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("text_sha256"), pa.array(found, pa.int64())], ["text_sha256", "n_tokens"])

    return texts.select("text_sha256", "content").mapInArrow(run, "text_sha256 string, n_tokens long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(
    spark: SparkSession, docs: DataFrame, path: str, cache: str | None = None, limit: int = LIMIT, normal: Callable[[Column], Column] = whole
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, text_sha256) of every row of docs(doc_id, text).

    cache: name of a table that persists, whose counts are used and which gets the new ones; without it the cache is new
    and dropped again. n_bytes is the UTF-8 length of the text itself. Null counts as an empty text; texts of any length
    are encoded whole, one at a time if they are long; repeated rows, rows of one id and null ids each give a row; an empty
    table gives none; other columns are not read. Digests that a large share of the rows has are met by broadcast, and
    copies of a text are combined before texts are shuffled.
    """
    scratch, version = Scratch(spark, "tokens"), tokenizer_version(path)
    content = normal(F.col("text"))
    digest = F.sha2(content, 256).alias("text_sha256")
    rows = scratch.save(docs.select("doc_id", F.octet_length(whole(F.col("text"))).cast("long").alias("n_bytes"), digest), "rows")
    store = TokenCache(spark, cache or f"tessera_tokens_{uuid.uuid4().hex}", min(max(BUCKETS[0], rows.count() // BUCKET_ROWS), BUCKETS[1]))
    try:
        misses = scratch.save(store.misses(rows, version), "misses")
        texts = docs.select(digest, content.alias("content"))
        few = misses.count() <= BROADCAST_MISSES
        if few:
            texts = texts.join(F.broadcast(misses), "text_sha256", "left_semi")
        texts = texts.groupBy("text_sha256").agg(F.first("content").alias("content"))
        if not few:
            texts = texts.join(misses.hint("merge"), "text_sha256", "left_semi")
        store.append(scratch.save(encode_counts(texts, path, version), "counted"), version)
        found = spread_join(rows, store.counts(version), "text_sha256")
        over = (F.col("n_tokens") > limit).alias("over_limit")
        return scratch.save(found.select("doc_id", "n_bytes", "n_tokens", over, "text_sha256"), "result")
    finally:
        if not cache:
            store.drop()


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of bytes and tokens of every document, through a cache that is new each time."""
    return token_counts(spark, documents(spark, sf_dir), default_tokenizer())
