"""What each of five filters removes, in every order of them, and which of it the others would have removed.

Duplicates, one of the filters, are found by refining a partition: documents are split by their length in code points, then
by the hash of one block of text after the other; whatever is alone in its class leaves. The texts of the classes that are
left are compared in full with that of the class's smallest id. Each document then has a mask of the filters it fails,
and everything that is reported is a sum over the numbers of documents by mask.
"""

from __future__ import annotations

import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, slices, spread_join, table, text_bytes

#: the filters, each a bit of the mask in this order
FILTERS = "ABCDE"
#: code points up to which the successive blocks of a text reach: each reaches 16 times as far as the one before, the last to any end
REACH = [*(256 * 16**k for k in range(6)), 2**31 - 1]
#: members of a class that are compared with the same copy of its first text in one task
MEMBERS = 500
#: classes that at least one row in so many is in are dealt out to several tasks
HOT = 200
#: bytes of a text that are split into words at once
PIECE = 1 << 20
_SPACE, _ODD = re.compile(rb"[\x20\x09-\x0D]"), np.isin(np.arange(256), list(b"#$%&*|"))


def hashed(block: bytes) -> int:
    return xxhash.xxh3_64_intdigest(block) - (1 << 63)


def word_counts(body: bytes, piece: int = PIECE) -> tuple[int, int]:
    """Numbers of words and of different words; a long text is taken piece by piece, cut at white space."""
    if len(body) <= piece:
        words = body.split()
        return len(words), len(set(words))
    n, seen, start = 0, set(), 0
    while start < len(body):
        cut = _SPACE.search(body, start + piece)
        stop = cut.start() if cut else len(body)
        words = body[start:stop].split()
        n, start = n + len(words), stop
        seen.update(words)
    return n, len(seen)


def measures(column: pa.Array, masks: bool = True, reach=REACH, digest=hashed):
    """(number of code points, hashes of the blocks, mask of the filters A to D, checksum) of each text of a column, null as empty.

    The bits: few words, few different ones, many capitals, odd characters. The hashes are of the successive blocks that
    `reach` bounds, as many as reach the text's end, one for an empty text. Without masks these are 0.
    """
    data, offsets = text_bytes(column)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets]
    first = (data & 0xC0) != 0x80
    begins, chars = np.flatnonzero(first), total(first)
    capitals, odd = (np.diff(total(x)).tolist() if masks else None for x in ((data - 65) < 26, _ODD[data]))
    offsets, chars, whole = offsets.tolist(), chars.tolist(), data.tobytes()
    for i in range(len(offsets) - 1):
        start, stop, n = offsets[i], offsets[i + 1], chars[i + 1] - chars[i]
        blocks, at = [], start
        for far in reach:
            to = int(begins[chars[i] + far]) if far < n else stop
            blocks.append(digest(whole[at:to]))
            at = to
            if far >= n:
                break
        mask = 0
        if masks:
            words, different = word_counts(whole[start:stop])
            mask = (words < 200) | (100 * different < 50 * words) << 1 | (100 * capitals[i] > 2 * n) << 2 | (odd[i] > 0) << 3
        yield n, blocks, mask, zlib.crc32(whole[start:stop])


def profile(docs: DataFrame, **how) -> DataFrame:
    """(id, part, n_chars, blocks, mask, crc) of docs(doc_id, text, source) in one pass over the texts; null text and source are empty."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                n, blocks, mask, crc = zip(*measures(batch.column("text"), **how))
                found = [pa.array(n, pa.int64()), pa.array(blocks, pa.list_(pa.int64())), pa.array(mask, pa.int32()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), *found], ["id", "part", "n_chars", "blocks", "mask", "crc"])

    docs = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    return docs.mapInArrow(run, "id long, part string, n_chars long, blocks array<long>, mask int, crc long")


def classed(docs: DataFrame, **how) -> DataFrame:
    """(id, body, cls, crc, seq) of docs(doc_id, text): the final class of each whole text, and the row's number in its task."""

    def run(batches):
        seq = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                n, blocks, _, crc = zip(*measures(batch.column("text"), masks=False, **how))
                found = [pa.array(n, pa.int64()), pa.array(blocks, pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in (crc, range(seq, seq + len(n))))]
                seq += len(n)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), *found], ["id", "body", "n_chars", "blocks", "crc", "seq"])

    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(run, "id long, body string, n_chars long, blocks array<long>, crc long, seq long")
    return rows.select("id", "body", "crc", "seq", chain(F.col("n_chars"), F.col("blocks")).alias("cls"))


def chain(n_chars, blocks):
    """Class of a text that all its blocks have refined."""
    return F.aggregate(blocks, F.xxhash64(n_chars), lambda at, block: F.xxhash64(at, block))


def refine(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, n, first) of the classes of two rows or more that no block tells apart; first is the smallest id, null if all are.

    rows(id, n_chars, blocks). One round a block: the rows still together take the block's hash into their class, those
    alone in it leave, and so do those without further blocks, whose class is final.
    """
    at, ended, k = rows.select("id", F.xxhash64("n_chars").alias("cls"), "blocks", F.lit(False).alias("ended")), [], 0
    while True:
        sizes = scratch.save(at.groupBy("cls").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), f"sizes-{k}")
        if sizes.isEmpty():
            break
        left = scratch.save(spread_join(at, sizes, "cls", "size").drop("size"), f"left-{k}")
        ended.append(left.filter("ended").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
        k += 1
        finer = F.xxhash64("cls", F.element_at("blocks", k))
        at = left.filter("NOT ended").select("id", finer.alias("cls"), "blocks", (F.size("blocks") == k).alias("ended"))
    found = rows.sparkSession.createDataFrame([], "cls long, n long, first long")
    for more in ended:
        found = found.unionByName(more)
    return scratch.save(found, "classes")


def unequal(docs: DataFrame, classes: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """(id, cls, crc, first) of the members whose text isn't that of their class's first id; first is the smallest id with theirs.

    Such rows exist only where hashes of different texts are equal. Every member is set against a copy of the first text;
    a class has a copy for every MEMBERS of its members, so that no task gets all of a large one. The texts of large
    classes are dealt out before they are shuffled.
    """
    copies = F.ceil(F.col("n") / MEMBERS).cast("long")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = classes.filter(F.col("n") * HOT >= total).select("cls", copies.alias("many"))
    turn = F.pmod("seq", F.coalesce("many", F.lit(1)))
    texts = classed(docs, **how).join(F.broadcast(hot), "cls", "left").select("id", "body", "crc", "seq", "cls", turn.alias("turn"))
    dealt = classes.join(F.broadcast(hot), "cls", "left").withColumn("copies", copies)
    dealt = dealt.select("cls", "first", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("many", F.lit(1)) - 1)).alias("turn"))
    members = scratch.save(texts.join(dealt, ["cls", "turn"]), "members")
    firsts = members.filter("id <=> first").groupBy("cls", "copies").agg(F.min("body").alias("same"))
    firsts = firsts.select("cls", "same", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("turn"))
    members = members.select("id", "cls", "crc", "body", F.pmod("seq", "copies").alias("turn"))
    other = scratch.save(members.join(firsts, ["cls", "turn"]).filter("body <> same").select("id", "cls", "crc", "body"), "unequal")
    least = other.groupBy("cls", "body").agg(F.min("id").alias("first"))
    return other.join(least, ["cls", "body"]).select("id", "cls", "crc", "first").distinct()


def later_copies(docs: DataFrame, rows: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """rows(id, n_chars, blocks, ..) of docs with a column `copy`: whether a smaller id has the very same text.

    A null id comes after all others; rows of one id aren't copies of each other.
    """
    classes = refine(rows, scratch)
    odd = scratch.save(unequal(docs, classes, scratch, **how), "odd")
    rows = scratch.save(rows.withColumn("cls", chain(F.col("n_chars"), F.col("blocks"))).drop("blocks", "n_chars"), "classed")
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    told = spread_join(rows, classes, "cls", "n", how="left").withColumn("copy", F.coalesce(later, F.lit(False))).drop("first", "n")
    if odd.isEmpty():
        return told
    odd = odd.select(F.col("id").alias("o"), F.col("cls").alias("c"), F.col("crc").alias("s"), later.alias("other"))
    told = told.join(odd, F.col("id").eqNullSafe(F.col("o")) & (F.col("cls") == F.col("c")) & (F.col("crc") == F.col("s")), "left")
    return told.withColumn("copy", F.coalesce("other", "copy")).drop("o", "c", "s", "other")


def orders(spark: SparkSession) -> DataFrame:
    """For every mask, order and step what a document of that mask counts as: the rules of the report, 32 x 120 x 5 rows.

    (mask, filter_order, step, kept, removed, redundant, unique_fails, shapley), each number 0 or 1 but the last, the
    number of orders in which the step's filter is the one that removes such a document.
    """
    rows = spark.createDataFrame([("".join(o),) for o in permutations(FILTERS)], "filter_order string")
    rows = rows.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    bit = lambda at: f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {at}, 1)) - 1)"
    rows = rows.withColumn("own", F.expr(bit("step")))
    before = F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (m, i) -> m | if(i < step, {bit('i')}, 0))")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(before) != 0
    number = lambda c: c.cast("long")
    return rows.select(
        "mask", "filter_order", "step", number(~fails & ~gone).alias("kept"), number(fails & ~gone).alias("removed"), number(fails & gone).alias("redundant"),
        number(F.col("mask") == F.col("own")).alias("unique_fails"), F.when(fails, F.lit(120) / F.bit_count("mask")).otherwise(0).cast("long").alias("shapley"),
    )


def audit_filters(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of docs(doc_id, text, source).

    One row for every source (null: empty), order and step, with zeros. labels(doc_id, quality, toxic) says what is good
    or toxic; a document is so if any row of its id is 1, and neither if it has none or a null id. Null texts are empty and
    copies of each other; repeated rows each count; texts are read whole; no documents give no rows; other columns
    aren't read. how: other blocks (`reach`) and another hash of them (`digest`), which change no result.
    """
    scratch = Scratch(spark, "filters")
    rows = scratch.save(profile(docs, **how), "rows")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = later_copies(docs, rows, scratch, **how)
    mask = F.col("mask") + F.when(F.col("copy"), 1 << FILTERS.index("E")).otherwise(0)
    told = told.select("id", "part", mask.alias("mask")).join(marks, F.col("id") == F.col("doc_id"), "left")
    counts = told.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("n_good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("n_toxic")
    )
    all_orders = orders(spark)
    sums = {c: F.sum(F.col("n") * F.col(c)) for c in ("kept", "removed", "redundant", "unique_fails")}
    sums |= {f"{c}_lost": F.sum(F.col(f"n_{c}") * F.col("removed")) for c in ("good", "toxic")}
    sums["shapley"] = F.sum(F.col("n") * F.col("shapley"))
    out = scratch.save(counts, "counts").join(F.broadcast(all_orders), "mask").groupBy("part", "filter_order", "step")
    return scratch.save(out.agg(*[v.alias(k) for k, v in sums.items()]), "result")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents, with their labels."""
    return audit_filters(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t
), m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN least IS NOT NULL AND (doc_id IS NULL OR doc_id > least) THEN 16 ELSE 0 END AS mask
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), n AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS n_good, sum(coalesce(toxic, 0)) AS n_toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask
), f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), s AS (
  SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::BIGINT AS before FROM o, range(1, 6) r(i)
), x AS (
  SELECT n.*, s.*, (mask & own) > 0 AS fails, (mask & before) > 0 AS gone FROM n, s
), y AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM y
"""
