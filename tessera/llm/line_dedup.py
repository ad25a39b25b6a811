"""Line dedup: a deletion-neighbourhood join over the lines of all documents.

Lines are compared as sequences of words. Equal lines of one word or more are found by hash, whatever their length.
From NEAR_WORDS words on, lines within one word edit (a word put in, left out or replaced) are the same too: every line
emits the hashes of itself and of all variants with one word deleted; equal variants meet, their distance is verified,
and the earliest line stays. A line goes if an earlier line, in the order of document id and place, is within the
bound, whether or not that one stays itself.

Two lines within one edit agree in the first or in the last half of the shorter one. So only lines that share such a
half with another line emit variants; this loses no pair. In a group of equal variants each line is set against the
earliest one only, a window minimum, so a large group costs as many rows as it has lines, never its pairs.

With whole=True the bound grows with the line, one edit from NEAR_WORDS words and one for every ten from FAR_WORDS, the
shorter line counting. Lines of FAR_WORDS words and more meet by their rarest grams, two neighbouring words each: k edits
change at most 2 k of the grams of a line, so two lines within k edits share one of the 2 k + 1 that come first in either,
in any order of all grams. Grams that a sample shows to be frequent come last, so that common phrases bring few lines
together; the order changes no result. A line is first set against the earliest line that it shares a key with; only
where that one isn't within the bound it is set against the others before it, by lengths and a signature of their words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE_CLASS, Scratch, documents, slices, text_bytes

#: fewer words: only equal lines count, as one edit is too much of the line
NEAR_WORDS = 5
#: word edits within which lines are the same; 0 or 1
MAX_EDITS = 1
#: with whole=True: from so many words on, more than one edit is within the bound
FAR_WORDS = 20
#: texts, about, and buckets of hashes, from which the order of grams is taken
SAMPLE_TEXTS, BUCKET_BITS = 4096, 18
#: long lines meet in so many slices of their keys, one after the other, so that shuffles of one are on disk at a time;
#: so many lines, or fewer, meet in one
KEY_SLICES, FEW_LINES = 4, 20_000


def _words(line: Column) -> Column:
    """Hashes of the words of a line: lines are compared by them, as words are hashed but once."""
    return F.transform(F.array_remove(F.split(line, SPACE_CLASS + "+"), ""), lambda w: F.xxhash64(w))


def _line_id(words: Column) -> Column:
    """128 bits of hash, as two numbers."""
    return F.struct(F.xxhash64(words).alias("a"), F.xxhash64(F.lit(1), words).alias("b"))


def _halves(words: Column, n: Column) -> Column:
    """Hashes of the halves that a line within one edit shares: for the shorter line as long as this, or one less."""
    keys = []
    for m in (n, n - 1):
        head = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit(0), m, F.slice(words, 1, head)))
        keys.append(F.xxhash64(F.lit(1), m, F.slice(words, n - (m - head) + 1, m - head)))
    return F.array(*keys)


def edit_bound(n):
    """Edits within which a line of n words (a number or a column) and a longer one are the same, with whole=True."""
    if isinstance(n, int):
        return 0 if n < NEAR_WORDS else max(1, n // 10)
    return F.when(n < NEAR_WORDS, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 10))).cast("int")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed."""
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to size of an odd number and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) <= size:
        base = 0x9E3779B97F4A7C15
        for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(size, 1 << 20), x, np.uint64)]), dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _far_lines(column: pa.Array):
    """Of the lines of FAR_WORDS words or more of some texts: (text, place, words, signatures), and (line, gram) of each
    different pair of neighbouring words, as numbers. A signature flips a bit for each word."""
    data, offsets = text_bytes(column)
    space = np.concatenate([(data == 32) | ((data >= 9) & (data <= 13)), [True]])
    edge = np.zeros(len(space), bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]])
    begin = np.flatnonzero(~space & (before | edge))
    end = np.flatnonzero(~space[:-1] & (space[1:] | edge[1:])) + 1
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    text = np.searchsorted(offsets, begin, side="right") - 1
    place = breaks[begin] - breaks[offsets[text]]
    starts = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1])])) if len(begin) else begin
    n = np.diff(np.append(starts, len(begin)))
    up, down = _powers_to(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    words = _mixed((sums[end] - sums[begin]) * down[begin])
    long = n >= FAR_WORDS
    words, text, place, n = words[np.repeat(long, n)], text[starts[long]], place[starts[long]], n[long]
    starts = np.cumsum(n) - n
    line = np.repeat(np.arange(len(n)), n)
    bit, half = np.uint64(1) << (words & np.uint64(63)), (words >> np.uint64(6)) & np.uint64(1)
    signs = [np.bitwise_xor.reduceat(np.where(half == h, bit, np.uint64(0)), starts).view(np.int64) if len(n) else starts for h in (0, 1)]
    grams = _mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    inner = line[1:] == line[:-1]
    line, grams = line[:-1][inner], grams[inner]
    order = np.lexsort((grams, line))
    line, grams = line[order], grams[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (grams[1:] != grams[:-1])
    return (text, place, n, signs), (line[new], grams[new])


def _buckets(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _gram_counts(rows: DataFrame) -> np.ndarray:
    """How often grams occur in about SAMPLE_TEXTS texts, by buckets of grams. Gives an order only, never a result."""
    share = SAMPLE_TEXTS / max(1, rows.count())

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, (_, grams) = _far_lines(part.column("text"))
                bucket, n = np.unique(_buckets(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], ["bucket", "n"])

    sample = rows.filter(F.pmod("__k", F.lit(1_000_000)) < share * 1_000_000).select("text")
    found = sample.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").cast("int").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, np.int32)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _keyed_lines(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(d, k, pos, n, s0, s1, keys) of each line of FAR_WORDS words or more.

    keys are its 2 k + 1 rarest grams. Each of k edits changes two grams at most, so the rarest gram that two lines
    within k edits share has at most 2 k others before it in either, in whatever order all lines' grams are put.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                (text, place, n, signs), (line, grams) = _far_lines(part.column("text"))
                order = np.lexsort((grams, counts[_buckets(grams)], line))
                line, grams = line[order], grams[order]
                size = np.bincount(line, minlength=len(n))
                at = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
                first = at <= 2 * np.maximum(n // 10, 1)[line]
                ends = np.concatenate([[0], np.cumsum(np.bincount(line[first], minlength=len(n)))])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams[first].view(np.int64), pa.int64()))
                docs = part.select(["d", "k"]).take(pa.array(text, pa.int64()))
                columns = [pa.array(place, pa.int32()), pa.array(n, pa.int32()), *[pa.array(s, pa.int64()) for s in signs], keys]
                yield pa.RecordBatch.from_arrays([*docs.columns, *columns], ["d", "k", "pos", "n", "s0", "s1", "keys"])

    texts = rows.select(F.col("__d").alias("d"), F.col("__k").alias("k"), "text")
    return texts.mapInArrow(run, "d bigint, k bigint, pos int, n int, s0 long, s1 long, keys array<long>")


def word_edits(a: list, b: list, bound: int) -> int:
    """Words put in, left out or replaced between a and b; bound + 1 where more than bound. Furthest reach by diagonal."""
    la, lb = len(a), len(b)
    if abs(la - lb) > bound:
        return bound + 1
    reach = {}
    for e in range(bound + 1):
        now = {}
        for d in range(-e, e + 1):
            i = 0 if e == 0 else max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -2))
            i = min(i, la, lb + d)
            if i < 0 or i < d:
                continue
            while i < la and i - d < lb and a[i] == b[i - d]:
                i += 1
            if i == la and i - d == lb:
                return e
            now[d] = i
        reach = now
    return bound + 1


def keyed_documents(docs: DataFrame) -> DataFrame:
    """docs with __d, its id (a null id as the largest), and __k, a hash of id and text."""
    return docs.withColumns({"__d": F.coalesce("doc_id", F.lit(NULL_ID)), "__k": F.xxhash64("doc_id", "text")})


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are equal or one word edit apart."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    head = F.array_position(same, F.lit(1))
    back = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    tail = F.array_position(back, F.lit(1))
    # words that agree in front and behind; 0 stands for no difference
    front = F.when(head == 0, long).otherwise(head - 1)
    behind = F.when(tail == 0, long).otherwise(tail - 1)
    return (long - short <= 1) & (front + behind >= long - 1)


def duplicate_lines(spark: SparkSession, docs: DataFrame, scratch: Scratch, max_edits: int = MAX_EDITS, whole: bool = False) -> DataFrame:
    """(d, k, drops): for documents with lines to drop, an array of (pos, near).

    Documents are named by id and by a hash of id and text; rows that repeat both are one document. Lines are what
    stands between newlines, however long; lines without words, null and empty texts have none to drop. Of equal places
    none is tied, as document and line order them. An empty table gives no rows. With max_edits 0 only equal lines count.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    rows = keyed_documents(docs.select("doc_id", "text")).filter("text IS NOT NULL")
    # outer: no filter on the number of lines, which would split every text twice
    words = F.transform(F.split("text", "\n", -1), _words)
    lines = rows.select("__d", "__k", F.posexplode_outer(words).alias("pos", "w")).withColumn("n", F.size("w"))
    lines = lines.filter(F.col("n") >= 1)
    far = [F.col("n").alias("n_words")] if whole and max_edits else []
    # with whole=True two lines of FAR_WORDS words or more meet by their grams; a shorter one meets none over FAR_WORDS
    halved = (F.col("n") >= NEAR_WORDS) & (F.col("n") <= FAR_WORDS) if far else F.col("n") >= NEAR_WORDS
    lines = lines.select(
        F.col("__d").alias("d"), F.col("__k").alias("k"), "pos", _line_id(F.col("w")).alias("id"),
        F.when(halved, _halves(F.col("w"), F.col("n"))).alias("halves"), *far,
    )
    lines = scratch.save(lines.select("d", "k", "pos", "id.a", "id.b", "halves", *["n_words"] * len(far)), "lines")
    place = F.struct("d", "k", "pos")
    first = lines.groupBy("a", "b").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in lines.columns[5:]])
    first = scratch.save(first, "first")
    near = _near_lines(spark, rows, first, scratch) if max_edits else None

    # places to drop: all but the first of equal lines, and every place of a line that has an earlier near one
    some = first.filter("n > 1").select("a", "b", "at", F.lit(False).alias("near"))
    if near is not None:
        near = near.select("a", "b", F.lit(True).alias("is_near"))
        some = first.join(near.hint("merge"), ["a", "b"], "left").filter("n > 1 OR is_near").select("a", "b", "at", F.coalesce("is_near", F.lit(False)).alias("near"))
    some = scratch.save(some, "some")
    drops = lines.drop("halves", "n_words").join(some.hint("merge"), ["a", "b"]).filter(F.col("near") | (place != F.col("at")))
    drops = drops.select("d", "k", "pos", "near").distinct().groupBy("d", "k").agg(F.collect_list(F.struct("pos", "near")).alias("drops"))
    drops = scratch.save(drops, "drops")
    scratch.drop("lines", "first", "some")
    return drops


def _far_members(rows: DataFrame, first: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """(key, x, leader, open), a table for each slice of keys: different lines of FAR_WORDS words or more that share a key, as (at, n, s0, s1, prev); prev
    is the line's key before this one. leader is the place of the earliest line of the key, where x may be near it.

    open tells the lines that another line than the leader may come before or behind, so the key has three or more of
    them and x isn't the leader. Rows that are of no use for either are left out.
    """
    places = first.filter(F.col("n_words") >= FAR_WORDS).select("at.d", "at.k", "at.pos")
    lines = _keyed_lines(rows, _gram_counts(rows)).join(places.hint("merge"), ["d", "k", "pos"]).dropDuplicates(["d", "k", "pos"])
    lines = scratch.save(lines.withColumn("line", F.xxhash64("d", "k", "pos")), "far")
    keys = lines.select("line", F.explode(F.arrays_zip("keys", F.concat(F.array(F.lit(0).cast("long")), F.slice("keys", 1, F.size("keys") - 1)).alias("before"))).alias("x"))
    keys = keys.select("line", F.col("x.keys").alias("key"), F.col("x.before").alias("prev"))
    info = lines.select("line", F.struct("d", "k", "pos").alias("at"), "n", "s0", "s1")
    n = KEY_SLICES if lines.count() > FEW_LINES else 1
    members = []
    for i in range(n):
        some = keys.filter(F.pmod("key", F.lit(n)) == i) if n > 1 else keys
        # keys of one line only are dropped before the lines' places are joined
        some = some.withColumn("lines", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("lines > 1").drop("lines")
        some = scratch.save(some, "keys")
        scratch.tidy()
        far = some.join(info.hint("merge"), "line").select("key", F.struct("at", "n", "s0", "s1", "prev").alias("x"))
        group, later = Window.partitionBy("key"), F.col("x.at") != F.col("l.at")
        far = far.select("key", "x", F.min("x").over(group).alias("l"), F.count(F.lit(1)).over(group).alias("lines"))
        far = far.select("key", "x", F.when(later & _may_be_near("x", "l"), F.col("l.at")).alias("leader"), (later & (F.col("lines") > 2)).alias("open"))
        members.append(scratch.save(far.filter("leader IS NOT NULL OR open"), f"members{i or ''}"))
        scratch.drop("keys")
        scratch.tidy()
    scratch.drop("far")
    return members


def _may_be_near(x: str, y: str) -> Column:
    """Whether two lines that share a key may be within the bound, by their lengths and signatures."""
    k = edit_bound(F.least(f"{x}.n", f"{y}.n"))
    apart = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("s0", "s1")), F.lit(0))
    return (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= k) & (apart <= 2 * k)


def _words_at(rows: DataFrame, places: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(at, w): the words of the lines at places(d, k, pos), by document and line."""
    wanted = scratch.save(places.distinct().groupBy("d", "k").agg(F.collect_list("pos").alias("wanted")), f"{name}-places")
    texts = rows.join(wanted.hint("merge"), [F.col("__d") == F.col("d"), F.col("__k") == F.col("k")])
    numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.when(F.array_contains("wanted", i), F.struct(i.alias("pos"), line.alias("line"))))
    texts = texts.dropDuplicates(["d", "k"]).select("d", "k", F.explode_outer(F.array_compact(numbered)).alias("l"))
    texts = scratch.save(texts.select(F.struct("d", "k", "l.pos").alias("at"), _words(F.col("l.line")).alias("w")), name)
    scratch.drop(f"{name}-places")
    return texts


def _places(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("at", "other")).alias("l")).select("l.*")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(at) of the pairs(at, other) whose words are within the bound."""
    left, right = texts.select("at", F.col("w").alias("x")), texts.select(F.col("at").alias("other"), F.col("w").alias("y"))
    both = pairs.hint("merge").join(left, "at").join(right.hint("merge"), "other").select("at.*", "x", "y")
    return both.mapInArrow(_within_bound, "d bigint, k bigint, pos int").select(F.struct("d", "k", "pos").alias("at")).distinct()


def _may_be_within(a: list, b: list, bound: int) -> bool:
    """False where words or grams tell that two lines are further apart: an edit takes one word and two grams at most."""
    if len(set(a).difference(b)) > bound or len(set(b).difference(a)) > bound:
        return False
    x, y = set(zip(a, a[1:])), set(zip(b, b[1:]))
    return len(x - y) <= 2 * bound and len(y - x) <= 2 * bound


def _within_bound(batches):
    for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        bounds = [edit_bound(min(len(a), len(b))) for a, b in zip(x, y)]
        near = [_may_be_within(a, b, k) and word_edits(a, b, k) <= k for a, b, k in zip(x, y, bounds)]
        near = pa.array(near, pa.bool_())
        yield batch.select(["d", "k", "pos"]).filter(near)


def _near_lines(spark: SparkSession, rows: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of the lines that have an earlier line one edit away, or within the bound where first has `far`."""
    halves = first.filter("halves IS NOT NULL").select("at", F.explode("halves").alias("half"))
    shared = halves.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("half"))).filter("m > 1")
    shared = shared.select("at.d", "at.k", "at.pos").distinct()
    members = led = None
    if "n_words" in first.columns:
        members = _far_members(rows, first, scratch)
        led = [m.filter("leader IS NOT NULL").select("x.at", F.col("leader").alias("other")) for m in members]
        led = scratch.save(reduce(DataFrame.unionByName, led).distinct(), "led")
        scratch.tidy()
        shared = shared.unionByName(_places(led)).distinct()
    # the words of those lines, from the document where each occurs first
    texts = _words_at(rows, shared, scratch, "words")

    variants = F.concat(
        F.array(F.xxhash64("w")),
        F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.xxhash64(F.concat(F.slice("w", 1, i - 1), F.slice("w", i + 1, F.size("w"))))),
    )
    # place 0: the line itself; place i: without word i
    short = texts if members is None else texts.filter(F.size("w") <= FAR_WORDS)
    emitted = short.select("at", F.posexplode_outer(variants).alias("i", "variant"))
    group, deleted = Window.partitionBy("variant"), Window.partitionBy("variant", "i")
    emitted = emitted.select(
        "at", "i",
        F.min("at").over(deleted).alias("replaced"),
        F.min(F.when(F.col("i") == 0, F.col("at"))).over(group).alias("shorter"),
        F.min(F.when(F.col("i") > 0, F.col("at"))).over(group).alias("longer"),
    )
    other = F.when(F.col("i") == 0, F.col("longer")).otherwise(F.least("replaced", "shorter"))
    pairs = emitted.select("at", other.alias("other")).filter(F.col("other") < F.col("at")).distinct()
    pairs = scratch.save(pairs, "pairs")
    left = texts.select("at", F.col("w").alias("x"))
    right = texts.select(F.col("at").alias("other"), F.col("w").alias("y"))
    checked = pairs.hint("merge").join(left, "at").join(right.hint("merge"), "other").filter(within_one_edit(F.col("x"), F.col("y"))).select("at").distinct()
    if members is not None:
        # most lines are near the earliest one of a key; only those that aren't are set against the others before them,
        # at the first of keys that follow each other in both lines
        checked = scratch.save(checked.unionByName(_verified(led, texts)).distinct(), "near1")
        scratch.drop("words")
        scratch.tidy()
        rest = []
        for i, m in enumerate(members):
            mine = m.filter("open").select("key", "x")
            left = mine.join(checked.hint("merge"), F.col("x.at") == checked["at"], "left_anti")
            other = mine.select("key", F.col("x").alias("y"))
            left = left.join(other.hint("merge"), "key").filter("y.at < x.at").filter("x.prev = 0 OR x.prev <> y.prev").filter(_may_be_near("x", "y"))
            rest.append(scratch.save(left.select("x.at", F.col("y.at").alias("other")).distinct(), f"rest{i or ''}"))
            scratch.drop(f"members{i or ''}")
            scratch.tidy()
        # a pair may share keys of two slices
        rest = reduce(DataFrame.unionByName, rest).distinct() if len(rest) > 1 else rest[0]
        checked = checked.unionByName(_verified(rest, _words_at(rows, _places(rest), scratch, "more")))
    checked = scratch.save(checked.join(first.select("at", "a", "b").hint("merge"), "at").select("a", "b").distinct(), "near")
    scratch.drop("words", "more", "pairs", "led", "near1", *(f"rest{i or ''}" for i in range(KEY_SLICES)))
    scratch.tidy()
    return checked


def _with_kept_lines(spark: SparkSession, rows: DataFrame, scratch: Scratch, max_edits: int, whole: bool = False) -> DataFrame:
    """rows(doc_id, text, row) with `kept` text and the counts n_lines, n_exact, n_near, n_kept."""
    drops = duplicate_lines(spark, rows, scratch, max_edits, whole).select(F.col("d").alias("__d"), F.col("k").alias("__k"), "drops")
    out = keyed_documents(rows).join(drops.hint("merge"), ["__d", "__k"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("drops.pos"), i))
    none = F.col("drops").isNull()
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    near = F.when(none, 0).otherwise(F.size(F.filter("drops", lambda x: x["near"])))
    every = F.when(none, 0).otherwise(F.size("drops"))
    text = F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(
        "doc_id", "text", "row", text.alias("kept"), size.alias("n_lines"), (every - near).alias("n_exact"), near.alias("n_near"), (size - every).alias("n_kept")
    )


def dedup_lines(spark: SparkSession, docs: DataFrame, scratch: Scratch, max_edits: int = MAX_EDITS, whole: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, n_kept, text) of every row of docs(doc_id, text), text without dropped lines.

    A null text stays null and has no lines; an empty one has one line. Other columns are not read.
    """
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("row"))
    out = _with_kept_lines(spark, rows, scratch, max_edits, whole)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", "n_kept", F.col("kept").alias("text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, n_kept, text) of every document."""
    return dedup_lines(spark, documents(spark, sf_dir), Scratch(spark, "lines"))


def op2_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_line_dedup, with the bound that grows with the line."""
    return dedup_lines(spark, documents(spark, sf_dir), Scratch(spark, "lines"), whole=True)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated lines. A document of which no word is left goes, if it had any.

    n_chars, where it is a column, is counted again for the texts that changed; all other columns stay as they were,
    whatever their names.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = _with_kept_lines(spark, rows, Scratch(spark, "lines"), MAX_EDITS, whole=True)
    word = r"[^\x20\x09-\x0D]"
    out = out.filter(~F.coalesce(F.col("text").rlike(word), F.lit(False)) | F.col("kept").rlike(word))
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_kept") < F.col("n_lines"), F.length("kept").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
