"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts become lower-case words of letters and digits. Fixed masks of a few word positions, some of them ignored, are
hashed at every position of every document and of every benchmark item; equal hashes of one mask are hits. Around the
diagonal of a hit the words are compared: an item is in a document if at least one window of WINDOW words of the item
(or the whole of a shorter item) lies in the document with at most `tolerance` words substituted. The masks are
lossless: `tolerance` gives the largest number of substitutions for which each such window has a hit. Items that are
shorter than the masks are looked for as they are, by a hash of all their words at each position of a document.

Cost: the documents' seeds are probed against the benchmark's where they are made; nothing is shuffled but hits, and
the texts of documents with hits.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, documents, table

#: 1: the word counts, 0: it is ignored
MASKS = ("11101111", "11110111")
WINDOW = 24
#: items with fewer words than the masks span are held only where all their words stand in the document
MASK_WORDS = max(map(len, MASKS))
#: substituted words allowed: one in eight
ALLOWED_IN = 8
#: words of a benchmark whose seeds are broadcast; above, the join shuffles both sides
BROADCAST_WORDS = 500_000


@lru_cache
def tolerance(words: int) -> int:
    """Substitutions that a window of so many words may have: one in eight, and never more than the masks can find."""
    most = words // ALLOWED_IN
    shapes = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    placed = [frozenset(p + i for i in s) for s, m in zip(shapes, MASKS) for p in range(words - len(m) + 1)]
    for k in range(most, 0, -1):
        if all(any(not (p & set(c)) for p in placed) for c in combinations(range(words), k)):
            return k
    return 0


def words_of(text: Column) -> Column:
    """Hashes of the words of a text, null as empty."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _at(words: Column, k: int, taken: list[int]):
    return lambda p: F.xxhash64(F.lit(k), *[F.get(words, p + i) for i in taken])


def seeds_of(words: Column) -> Column:
    """Hashes of all masks at all positions: first those of the first mask, as many of each mask."""
    last = F.size(words) - MASK_WORDS
    each = []
    for k, mask in enumerate(MASKS):
        taken = [i for i, c in enumerate(mask) if c == "1"]
        each.append(F.transform(F.sequence(F.lit(0), last), _at(words, k, taken)))
    return F.when(last >= 0, F.concat(*each))


def _seeds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, seed) of rows(keys, w)."""
    rows = rows.select(*keys, (F.size("w") - MASK_WORDS + 1).alias("each"), seeds_of(F.col("w")).alias("seeds"))
    # outer: else a filter on the number of seeds, with all that they are made of, goes down to the scan
    rows = rows.select(*keys, "each", F.posexplode_outer("seeds").alias("at", "seed"))
    return rows.select(*keys, (F.col("at") % F.col("each")).alias("at"), "seed")


def _short_seeds(rows: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """(keys, at, seed) of rows(keys, w): hashes of all runs of so many words."""
    none = F.array().cast("array<struct<at:int,seed:bigint>>")
    at = lambda n: lambda p: F.struct(p.alias("at"), _at(F.col("w"), -n, list(range(n)))(p).alias("seed"))
    runs = [F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), at(n))).otherwise(none) for n in lengths]
    rows = rows.select(*keys, F.explode_outer(F.concat(*runs)).alias("x"))
    return rows.select(*keys, "x.at", "x.seed")


def find_overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, k, item_id, matches, window): documents (by id, null as the largest, and by a hash of id and text) with the
    benchmark items they hold, and the most equal words in a window of so many.

    Null and empty texts hold nothing, an item without words is held by none; repeated rows or items give one result;
    of windows with as many equal words it doesn't matter which is meant. Long texts are searched whole. An empty
    table gives no rows; columns other than doc_id, text and item_id, text are not read.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    items = scratch.save(items.dropDuplicates(["item_id", "iw"]).withColumn("item", F.monotonically_increasing_id()), "items")
    total = items.agg(F.coalesce(F.sum(F.size("iw")), F.lit(0))).first()[0]
    small = total <= BROADCAST_WORDS
    # at most MASK_WORDS - 1 numbers
    short = sorted(r["n"] for r in items.select(F.size("iw").alias("n")).filter(F.col("n") < MASK_WORDS).distinct().collect())
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.xxhash64("doc_id", "text").alias("k"), F.col("text")
    )
    words, own = keyed.select("d", "k", words_of(F.col("text")).alias("w")), items.select("item", F.col("iw").alias("w"))
    probe, seeds = _seeds(own, ["item"]), _seeds(words, ["d", "k"])
    if short:
        few = _short_seeds(own.filter(F.size("w") < MASK_WORDS), ["item"], short)
        probe, seeds = probe.unionByName(few), seeds.unionByName(_short_seeds(words, ["d", "k"], short))
    probe = probe.filter("seed IS NOT NULL").withColumnRenamed("at", "item_at")
    hits = seeds.join(F.broadcast(probe) if small else probe, "seed")
    hits = hits.select("d", "k", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = scratch.save(hits, "hits")

    # words of the documents with hits, once each; then one row for each diagonal
    lists = hits.groupBy("d", "k").agg(F.collect_list(F.struct("item", "shift")).alias("lists"))
    found = keyed.join(lists.hint("merge"), ["d", "k"]).select("d", "k", words_of(F.col("text")).alias("w"), F.explode("lists").alias("hit"))
    found = found.select("d", "k", "w", "hit.item", "hit.shift")
    found = found.join(F.broadcast(items) if small else items, "item")
    n = F.size("iw")
    width = F.least(F.lit(WINDOW), n)
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.get("w", F.col("shift") + i) == F.get("iw", i), 1).otherwise(0))
    found = found.select("d", "k", "item_id", width.alias("window"), n.alias("n"), equal.alias("eq"))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.col("n") - F.col("window")),
            lambda s: F.aggregate(F.slice("eq", s + 1, F.col("window")), F.lit(0), lambda a, x: a + x),
        )
    )
    found = found.select("d", "k", "item_id", "window", best.alias("matches"))
    allowed = F.coalesce(*[F.when(F.col("window") == w, tolerance(w)) for w in range(1, WINDOW + 1)])
    found = found.filter(F.col("matches") >= F.col("window") - allowed)
    return found.groupBy("d", "k", "item_id").agg(F.max("matches").alias("matches"), F.max("window").alias("window"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, matches, window) of every document that holds a benchmark item, once for an id and an item."""
    scratch = Scratch(spark, "seeds")
    found = find_overlaps(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), scratch)
    found = found.groupBy("d", "item_id").agg(F.max("matches").alias("matches"), F.max("window").alias("window"))
    return found.select(F.nullif("d", F.lit(NULL_ID)).alias("doc_id"), "item_id", "matches", "window")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item, with their columns as they were.

    Null and empty texts stay; rows that repeat id and text go or stay together; an empty table gives no rows.
    """
    scratch = Scratch(spark, "seeds")
    found = find_overlaps(spark, docs, table(spark, sf_dir, "benchmark"), scratch)
    bad = scratch.save(found.select(F.col("d").alias("__d"), F.col("k").alias("__k")).distinct(), "bad")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.coalesce("doc_id", F.lit(NULL_ID)).alias("__d"), F.xxhash64("doc_id", "text").alias("__k"))
    return keyed.join(bad.hint("merge"), ["__d", "__k"], "left_anti").select("row.*")
