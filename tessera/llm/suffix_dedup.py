"""Suffix dedup: removal of byte strings that occur earlier, by a logarithmic family of sparse suffix arrays.

A string of LENGTH bytes that occurs twice has the same smallest GRAM-byte hash inside at both places, so it is enough
to index the suffixes at these places, about one in forty bytes. The suffixes of a batch of documents, sorted by the
hash of their first bytes and then by the hash of all the bytes that a string through this place can have (their
context), are its suffix array. A new batch is merge-scanned against the levels of the index: sorted with them, equal
beginnings stand together. Then the batch becomes a level, and levels of equal size merge into one of twice the size,
so each suffix is rewritten a logarithmic number of times. Batches come in the order of documents. Equal suffixes of
one slice of text are combined before they are shuffled, so a passage that many documents share costs one row a slice.

A suffix whose context occurs earlier is removed with its whole context. Where contexts differ behind an equal
beginning, which happens at the ends of repeated passages, every string through the place is compared by its hash.
Positions where nothing repeats cost one indexed row in forty bytes, and no text is kept in the index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, Scratch, documents, slices, text_bytes
from .jaccard import _mix

#: bytes of a string that is removed if it occurs earlier, and of the beginnings that are hashed
LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM
#: batches that a whole table is added in: the levels of the first two, and then of all four, merge
BATCHES = 4
#: bytes of text that are hashed at once in a task
SLICE = 1 << 19
#: strings through one beginning that meet in one task, at least and at most; more are dealt out by their hashes
MEET = 250_000, 4_000_000

_SYMBOL = _mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOW = np.uint64(0xFFFFFFFF)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


class Windows:
    """Hashes over the texts of a batch, which stand apart by LENGTH places of padding.

    grams and strings: hashes of the GRAM and LENGTH symbols from each place. starts: the first place of each text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.sizes = sizes
        self.starts = LENGTH + offsets[:-1] + LENGTH * np.arange(len(sizes))
        x = np.full(int(LENGTH + len(data) + LENGTH * len(sizes) + 2 * LENGTH), _SYMBOL[256], np.uint64)
        place = np.arange(len(data)) + np.repeat(self.starts - offsets[:-1], sizes)
        x[place] = _SYMBOL[data]
        n = len(x) - LENGTH
        twice = lambda a, k: a[: len(a) - k] * _power(k) + a[k:]
        four = twice(twice(x, 1), 2)
        del x, place
        eight = twice(four, 4)
        sixteen = twice(eight, 8)
        self.grams = _mix(sixteen[:n] * _power(8) + eight[16 : 16 + n])
        del eight
        half = twice(sixteen, 16)
        del sixteen
        self.strings = _mix((twice(half, 32)[:n] * _power(32) + half[64 : 64 + n]) * _power(4) + four[96 : 96 + n])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor: its place, its text, and first place and number of the strings whose smallest gram it is."""
        keyed = (self.grams & ~_LOW) | np.arange(len(self.grams), dtype=np.uint64)
        low = keyed
        for k in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[: len(low) - k], low[k:])
        size = REACH + 1
        low = np.minimum(low[: len(low) - (size - 64)], low[size - 64 :])
        counts = np.maximum(self.sizes - LENGTH + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        first = np.arange(len(text)) + np.repeat(self.starts - (np.cumsum(counts) - counts), counts)
        anchor = (low[first] & _LOW).astype(np.int64)
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        return anchor[at], text[at], first[at], np.diff(np.append(at, len(anchor)))

    def contexts(self, anchor: np.ndarray) -> np.ndarray:
        return _mix(self.strings[anchor - REACH] * _BASE + self.strings[anchor])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def suffixes(rows: DataFrame) -> DataFrame:
    """(h, c, d, k, pos, more) of rows(d, k, text): hash of the beginning and of the context of each indexed suffix.

    Each (h, c) stands once for a slice of text, at its first place there; more holds its other places, null if none.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                w = Windows(*text_bytes(batch.column("text")))
                anchor, text, _, _ = w.anchors()
                d, k = (np.array(batch.column(name), np.int64)[text] for name in ("d", "k"))
                h, c, pos = w.grams[anchor], w.contexts(anchor), (anchor - w.starts[text]).astype(np.int32)
                order = np.lexsort((pos, k, d, c, h))
                h, c, d, k, pos = (x[order] for x in (h, c, d, k, pos))
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                at = np.flatnonzero(new)
                ends = np.append(at, len(h)) - np.arange(len(at) + 1)  # of the other places of each
                places = pa.StructArray.from_arrays([pa.array(x[~new]) for x in (d, k, pos)], ["d", "k", "pos"])
                more = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places, mask=pa.array(np.diff(ends) == 0))
                cols = [_signed(h[at]), _signed(c[at]), *(pa.array(x[at]) for x in (d, k, pos)), more]
                yield pa.RecordBatch.from_arrays(cols, ["h", "c", "d", "k", "pos", "more"])

    return rows.select("d", "k", "text").mapInArrow(run, "h long, c long, d long, k long, pos int, more array<struct<d: long, k: long, pos: int>>")


class IndexFamily:
    """Levels of suffixes (h, c, d, k, pos), each distinct (h, c) once in a level, at its first place.

    A level holds 2^i batches; there is at most one level of each size.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch, self.levels, self.added = spark, scratch, {}, 0

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds documents (d, k, text), all behind those added before; returns the marked suffixes (d, k, pos, edge).

        edge false: the context occurs earlier. edge true: the first place of a context, with an equal beginning that
        goes on in another way, in the batch or before.
        """
        self.added += 1
        scan = suffixes(rows).withColumn("new", F.lit(True))
        for level, _ in self.levels.values():
            scan = scan.unionByName(level.withColumn("new", F.lit(False)), allowMissingColumns=True)
        same = Window.partitionBy("h", "c").orderBy("d", "k", "pos")
        scan = scan.select(
            "*", (F.row_number().over(same) > 1).alias("again"),
            (F.min("c").over(Window.partitionBy("h")) != F.max("c").over(Window.partitionBy("h"))).alias("parts"),
        )
        scan = self.scratch.save(scan.filter("new OR parts"), f"scan{self.added}")
        marks = self.scratch.save(_marks(scan), f"marks{self.added}")
        # no (h, c) stands in two levels, as what an earlier one holds is a repeat
        size, held, names = 0, scan.filter("new AND NOT again").select("h", "c", "d", "k", "pos"), [f"scan{self.added}"]
        while size in self.levels:
            level, name = self.levels.pop(size)
            held = held.unionByName(level)
            names.append(name)
            size += 1
        name = f"level{self.added}-{size}"
        self.levels[size] = self.scratch.save(held, name), name
        self.scratch.drop(*names)
        return marks


def _marks(scan: DataFrame) -> DataFrame:
    """(d, k, pos, edge) of a scan: its repeats and edges, and all that were combined with a row of it as repeats."""
    mark = lambda d, k, pos, edge: F.struct(d.alias("d"), k.alias("k"), pos.alias("pos"), edge.alias("edge"))
    own = F.when(F.col("again") | F.col("parts"), F.array(mark(F.col("d"), F.col("k"), F.col("pos"), ~F.col("again"))))
    more = F.transform("more", lambda x: mark(x["d"], x["k"], x["pos"], F.lit(False)))
    every = F.when(F.col("more").isNull(), own).when(own.isNull(), more).otherwise(F.concat(own, more))
    return scan.filter("again OR parts OR more IS NOT NULL").select(F.inline(every))


def _edge_strings(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(h, d, k, start, strings): hashes of the strings at each edge, from the place `start` on."""
    lists = edges.groupBy("d", "k").agg(F.collect_set("pos").alias("places"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                w = Windows(*text_bytes(batch.column("text")))
                anchor, text, first, n = w.anchors()
                pos = anchor - w.starts[text]
                lengths = np.array(batch.column("places").value_lengths())
                owner = np.repeat(np.arange(batch.num_rows), lengths)
                want = owner.astype(np.int64) << 40 | np.array(batch.column("places").flatten(), np.int64)
                at = np.flatnonzero(np.isin(text.astype(np.int64) << 40 | pos, want))
                which = pa.array(text[at])
                begin = np.concatenate([[0], np.cumsum(n[at])])
                inside = np.arange(begin[-1]) + np.repeat(first[at] - begin[:-1], n[at])
                strings = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), _signed(w.strings[inside]))
                start = pa.array((first[at] - w.starts[text[at]]).astype(np.int32))
                cols = [_signed(w.grams[anchor[at]]), batch.column("d").take(which), batch.column("k").take(which), start, strings]
                yield pa.RecordBatch.from_arrays(cols, ["h", "d", "k", "start", "strings"])

    joined = rows.join(lists, ["d", "k"]).select("d", "k", "text", "places")
    return joined.mapInArrow(run, "h long, d long, k long, start int, strings array<long>")


def _dealt(strings: DataFrame) -> DataFrame:
    """strings with `part` and `places`: rows of a beginning with very many strings are cut up by the strings' hashes.

    How many parts a beginning has is counted; the counts that are above one are broadcast, at most one for each
    MEET[0] strings of a small table and for each MEET[1] of a large one. places is null where a row isn't cut.
    """
    counts = strings.groupBy("h").agg(F.sum(F.size("strings")).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(MEET[0], min(MEET[1], total // 2000))
    busy = sorted((r["h"], -(-r["n"] // most)) for r in counts.filter(F.col("n") > most).collect())
    if not busy:
        return strings.withColumns({"part": F.lit(0), "places": F.lit(None).cast("array<int>")})
    hashes = strings.sparkSession.sparkContext.broadcast((np.array([h for h, _ in busy], np.int64), np.array([n for _, n in busy], np.int64)))

    def run(batches):
        known, parts = hashes.value
        for batch in batches:
            h = np.array(batch.column("h"))
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            many = np.where(known[at] == h, parts[at], 1)
            out = {"row": [], "part": [], "start": [], "strings": [], "places": []}
            for i in np.flatnonzero(many > 1):
                flat = np.array(batch.column("strings")[int(i)].values, np.int64)
                part = (flat.view(np.uint64) % np.uint64(many[i])).astype(np.int64)
                place = np.arange(len(flat), dtype=np.int32) + batch.column("start")[int(i)].as_py()
                for p in np.unique(part):
                    for name, value in (("row", i), ("part", p), ("start", place[part == p][0]), ("strings", flat[part == p]), ("places", place[part == p])):
                        out[name].append(value)
            whole = pa.array(np.flatnonzero(many == 1))
            cols = [batch.column(c).take(whole) for c in ("h", "d", "k", "start", "strings")]
            cols += [pa.array(np.zeros(len(whole), np.int32)), pa.nulls(len(whole), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "d", "k", "start", "strings", "part", "places"])
            row = pa.array(np.array(out["row"], np.int64))
            cols = [batch.column(c).take(row) for c in ("h", "d", "k")] + [pa.array(out["start"], pa.int32()), pa.array(out["strings"], pa.list_(pa.int64()))]
            cols += [pa.array(out["part"], pa.int32()), pa.array(out["places"], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "d", "k", "start", "strings", "part", "places"])

    return strings.mapInArrow(run, "h long, d long, k long, start int, strings array<long>, part int, places array<int>")


def _repeated(strings: DataFrame) -> DataFrame:
    """(d, k, begin, stop): bytes covered by strings that stand earlier in the order of (d, k, start)."""

    def run(batches):
        seen, last = np.zeros(0, np.int64), None  # strings of a group that goes on from one batch to the next
        for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            h, part = np.array(batch.column("h")), np.array(batch.column("part"))
            n, flat = np.array(batch.column("strings").value_lengths()), np.array(batch.column("strings").flatten())
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + np.array(batch.column("start"))[row]
            cut = np.array(batch.column("places").is_valid())
            if cut.any():
                place[cut[row]] = np.array(batch.column("places").flatten())
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
            group = np.cumsum(new) - 1
            # equal strings of two groups differ in their beginnings, so they are no repeats of each other
            order = np.lexsort((np.arange(len(flat)), flat, group[row]))
            again = np.zeros(len(flat), bool)
            again[order[1:]] = (flat[order[1:]] == flat[order[:-1]]) & (group[row][order[1:]] == group[row][order[:-1]])
            head = group[row] == 0
            if last == (h[0], part[0]):
                again[head] |= np.isin(flat[head], seen)
            else:
                seen = np.zeros(0, np.int64)
            tail = np.unique(flat[group[row] == group[-1]])
            seen = np.union1d(seen, tail) if group[-1] == 0 else tail
            last = (h[-1], part[-1])
            hit = np.flatnonzero(again)
            if not len(hit):
                continue
            edge = np.ones(len(hit), bool)
            edge[1:] = (np.diff(place[hit]) != 1) | (np.diff(row[hit]) != 0)
            left = np.flatnonzero(edge)
            right = np.append(left[1:], len(hit)) - 1
            which = pa.array(row[hit[left]])
            cols = [batch.column("d").take(which), batch.column("k").take(which)]
            cols += [pa.array(place[hit[left]].astype(np.int32)), pa.array((place[hit[right]] + LENGTH).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["d", "k", "begin", "stop"])

    ordered = _dealt(strings).repartition("h", "part").sortWithinPartitions("h", "part", "d", "k", "start")
    return ordered.mapInArrow(run, "d long, k long, begin int, stop int")


def remove_repeats(spark: SparkSession, docs: DataFrame, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """(doc_id, spans, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs(doc_id, text).

    spans: the removed ranges of bytes, in order. Null counts as empty; texts under LENGTH bytes keep everything. A
    null id comes after all others. Rows that repeat id and text are one document, with one result for each row; rows
    that repeat only the id are ordered by a hash of their texts. Long texts are hashed whole; of ties the smaller id
    is earlier. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("d").alias("m")).first()
    # the hash of the text tells rows of one id apart; where ids are unique a constant takes its place
    rows = rows.withColumn("k", F.lit(0).cast("long") if ids["n"] == ids["m"] else F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("d", [i / batches for i in range(1, batches)], 10_000)).first()[0] or [] if batches > 1 else []
    cuts = sorted(set(cuts))
    family, marks = IndexFamily(spark, scratch), None
    once = rows if ids["n"] == ids["m"] else rows.dropDuplicates(["d", "k"])
    for low, high in zip([None, *cuts], [*cuts, None]):
        # on the column itself, so that the scan can skip row groups
        part = once if low is None else once.filter(F.col("doc_id").isNull() | (F.col("doc_id") > low))
        part = part if high is None else part.filter((F.col("doc_id") <= high) & F.col("doc_id").isNotNull())
        found = family.add(part.select("d", "k", "text"))
        marks = found if marks is None else marks.unionByName(found)
        scratch.tidy()
    once = once.drop("doc_id")
    scratch.drop(*(name for _, name in family.levels.values()))
    whole = marks.filter("NOT edge").select("d", "k", (F.col("pos") - REACH).alias("begin"), (F.col("pos") + LENGTH).alias("stop"))
    strings = scratch.save(_edge_strings(once, marks.filter("edge")), "strings")
    scratch.tidy()
    found = scratch.save(_repeated(strings), "repeated")
    scratch.drop("strings")
    scratch.tidy()
    ranges = whole.unionByName(found).groupBy("d", "k").agg(F.collect_list(F.struct("begin", "stop")).alias("ranges"))

    def run(parts):
        for batch in parts:
            out = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                text = text.as_py().encode()
                if not ranges.is_valid:
                    out.append(([], len(text), 0, hashlib.sha256(text).hexdigest()))
                    continue
                begin, stop = (np.clip(np.array(ranges.values.field(f), np.int64), 0, len(text)) for f in ("begin", "stop"))
                cover = np.zeros(len(text) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, stop, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((edge.reshape(-1, 2).tolist(), len(text), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            cols = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.list_(pa.list_(pa.int64())))]
            cols += [pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())]
            cols += [pa.array([len(x[0]) for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(ranges, ["d", "k"], "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, spans array<array<long>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(run, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what remove_repeats() leaves of every document."""
    out = remove_repeats(spark, documents(spark, sf_dir), Scratch(spark, "suffix"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
