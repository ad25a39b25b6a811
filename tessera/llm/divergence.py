"""How far the sources of a language differ in their words: every pair of sources, and each source's own terms.

Documents are counted to (language, source, term) sums. The terms a language keeps are dealt out to slices by hash and the
sources to blocks, so that a seat, one block on one slice, holds a bounded number of cells however large either grows.
Seats stay where they are, in buckets; compressed vectors of their peers come by in the rounds of a round-robin
tournament, one peer a round, and a meeting counts for both sides. A seat keeps a heap of the best terms of each of its
sources, and only those few are compared over all slices.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, slices, text_bytes

#: a language keeps the terms of at least so many of its documents; terms of a source that are ranked
DOCUMENTS, RANKS = 10, 10
#: sources of a block, and terms of a slice, about: at most BLOCK times that many cells are in memory for each side
BLOCK, SLICE = 16, 4096
#: shares are out of so many; added to each count
SCALE, ADDED = 1_000_000_000, 2
#: entries that a task counts before it hands them on, and bytes of a text that are taken at once
HELD, PIECE = 200_000, 1 << 20
#: what a byte is to a term: A to Z as a to z, a to z and bytes of other characters as they are, the rest separates
_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def count_terms(docs: DataFrame, most: int = HELD, piece: int = PIECE) -> DataFrame:
    """(lang, source, term, n, docs) of docs(text, lang, source): occurrences, and documents with the term.

    Null columns are ''. Every group has a row for the term '', which no text has, so that groups without terms are there.
    """

    def rows(held):
        keys = [(g, t, n, d[t]) for g, (c, d) in held.items() for t, n in c.items()]
        cols = [[g[k] for g, *_ in keys] for k in (0, 1)] + [[x[k] for x in keys] for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()])], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        held, size = {}, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                data, offsets = data.tobytes().translate(_BYTES), offsets.tolist()
                groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
                for group, start, stop in zip(groups, offsets, offsets[1:]):
                    counts, docs_with = held.setdefault(group, (Counter({b"": 0}), Counter()))
                    size -= len(counts)
                    if stop - start <= piece:
                        words = data[start:stop].split()
                        counts.update(words)
                        docs_with.update(set(words))
                    else:
                        seen = set()
                        while start < stop:
                            cut = data.find(b" ", min(start + piece, stop), stop)
                            cut = stop if cut < 0 else cut
                            words = data[start:cut].split()
                            counts.update(words)
                            seen.update(words)
                            start = cut
                        docs_with.update(seen)
                    size += len(counts)
                if size > most:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    known = docs.select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    counted = known.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total, terms):
    """1 + floor(SCALE (n + ADDED) / (total + ADDED terms)), exact for numbers of any size."""
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")
    over = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * exact(n + ADDED, 19), exact(total + ADDED * terms, 20))
    return 1 + over


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are below 2^30, so all fits 64 bits."""
    return (p - q) ** 2 // (p + q)


def pack(groups: list, cells: dict[int, tuple[np.ndarray, np.ndarray]]) -> bytes:
    """A seat's vectors: for each source its number, its share where it has no count, and places and shares of the others.

    Places rise and are kept as differences; the whole is compressed.
    """
    parts = [np.array([len(groups)], np.int32)]
    for number, nothing in groups:
        places, shares = cells.get(number, (np.zeros(0, np.int32),) * 2)
        parts += [np.array([number, nothing, len(places)], np.int32), np.diff(places, prepend=0).astype(np.int32), shares.astype(np.int32)]
    return zlib.compress(np.concatenate(parts).tobytes(), 1)


def unpack(data: bytes):
    """(number, share of no count, places, shares) of each source of a seat."""
    a, at = np.frombuffer(zlib.decompress(data), np.int32), 1
    for _ in range(a[0]):
        number, nothing, n = a[at : at + 3].tolist()
        yield number, nothing, np.cumsum(a[at + 3 : at + 3 + n]), a[at + 3 + n : at + 3 + 2 * n]
        at += 3 + 2 * n


def dense(data: bytes, terms: int) -> tuple[list[int], np.ndarray]:
    """Numbers of a seat's sources, and their shares of every term of the slice."""
    numbers, out = [], []
    for number, nothing, places, shares in unpack(data):
        row = np.full(terms, nothing, np.int64)
        row[places] = shares
        numbers.append(number)
        out.append(row)
    return numbers, np.array(out, np.int64).reshape(len(out), terms)


def seats(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seats, terms, groups) of the counted terms.

    seats(lang, slice, block, blocks, n_terms, vectors, shares): every block of sources on every slice of its language's
    kept terms, with the language's own shares. terms(lang, slice, place, term), places rising by term from 0.
    groups(lang, number, source, block): the sources of a language numbered from 0.
    """
    groups = counts.filter("term = x''").select("lang", "source")
    counts = counts.filter("term <> x''")
    numbers = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("number", numbers).withColumn("block", F.floor(F.col("number") / BLOCK).cast("int"))
    groups = scratch.save(groups, "groups")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= DOCUMENTS)
    kept = scratch.save(kept.drop("docs"), "kept")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    sizes = scratch.save(sizes.withColumn("slices", F.ceil(F.col("terms") / SLICE).cast("int")), "sizes")
    dealt = kept.join(sizes, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices").cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1
    terms = dealt.withColumn("place", place).withColumn("q", share(F.col("all"), F.col("lang_total"), F.col("terms")))
    terms = scratch.save(terms.select("lang", "slice", "place", "term", "q"), "terms")
    # the language's shares of each slice, and the sources' counts at their places: both bounded by a slice and a block
    whole = terms.groupBy("lang", "slice").agg(F.count(F.lit(1)).cast("int").alias("n_terms"), F.transform(F.array_sort(F.collect_list(F.struct("place", "q"))), lambda x: x["q"]).alias("shares"))
    placed = scratch.save(counts.join(terms.drop("q"), ["lang", "term"]).join(groups, ["lang", "source"]).select("lang", "slice", "block", "number", "place", "n"), "placed")
    totals = placed.groupBy("lang", "number").agg(F.sum("n").alias("total"))
    totals = groups.join(totals, ["lang", "number"], "left").join(sizes, "lang").withColumn("total", F.coalesce("total", F.lit(0)))
    totals = scratch.save(totals.withColumn("nothing", share(F.lit(0), F.col("total"), F.col("terms"))), "totals")
    cells = placed.join(totals.select("lang", "number", "total", "terms"), ["lang", "number"])
    cells = cells.select("lang", "slice", "block", F.struct("number", "place", share(F.col("n"), F.col("total"), F.col("terms")).cast("int").alias("p")).alias("cell"))
    cells = cells.groupBy("lang", "slice", "block").agg(F.collect_list("cell").alias("cells"))
    blocks = totals.groupBy("lang", "block", "slices").agg(F.collect_list(F.struct("number", F.col("nothing").cast("int").alias("nothing"))).alias("members"))
    count = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    frame = blocks.join(count, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    frame = frame.join(whole, ["lang", "slice"]).join(cells, ["lang", "slice", "block"], "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column("members")[i].values
                groups = sorted(zip(members.field("number").to_pylist(), members.field("nothing").to_pylist()))
                found, cells = {}, batch.column("cells")[i]
                if cells.is_valid and len(cells):
                    number, where, p = (cells.values.field(k).to_numpy() for k in ("number", "place", "p"))
                    order = np.lexsort((where, number))
                    number, where, p = number[order], where[order], p[order]
                    ends = [*np.flatnonzero(np.diff(number)) + 1, len(number)]
                    found = {int(number[a]): (where[a:b], p[a:b]) for a, b in zip([0, *ends], ends)}
                row = batch.slice(i, 1).select(["lang", "slice", "block", "blocks", "n_terms", "shares"])
                yield row.append_column("vectors", pa.array([pack(groups, found)], pa.binary()))

    schema = "lang string, slice int, block int, blocks int, n_terms int, shares array<int>, vectors binary"
    frame = frame.withColumn("shares", F.col("shares").cast("array<int>"))
    return frame.mapInArrow(run, schema), terms, groups


def at_home(batches):
    """What a seat finds by itself: its sources' pairs, and a heap of the best terms of each. (lang, number, other, slice, place, value)"""
    for batch in batches:
        for at, row in enumerate(batch.select(["lang", "slice", "n_terms", "vectors"]).to_pylist()):
            numbers, shares = dense(row["vectors"], row["n_terms"])
            out = [(numbers[i], numbers[j], None, int(v)) for i in range(len(numbers)) for j, v in enumerate(apart(shares[i], shares).sum(axis=1)) if i != j]
            q_all = batch.column("shares")[at].values.to_numpy().astype(np.int64)
            for number, _, places, own in unpack(row["vectors"]):
                own, q = own.astype(np.int64), q_all[places]
                more = own > q
                value = apart(own[more], q[more]).tolist()
                best = heapq.nsmallest(RANKS, zip([-v for v in value], places[more].tolist()))
                out += [(number, None, place, -v) for v, place in best]
            yield _found(row, out)


def meet(batches):
    """A peer's vectors against those of the seat it comes by: each pair of sources counts for both."""
    for batch in batches:
        for row in batch.to_pylist():
            mine, p = dense(row["vectors"], row["n_terms"])
            theirs, q = dense(row["peer"], row["n_terms"])
            out = []
            for i, number in enumerate(mine):
                for other, value in zip(theirs, apart(p[i], q).sum(axis=1).tolist()):
                    out += [(number, other, None, value), (other, number, None, value)]
            yield _found(row, out)


FOUND = "lang string, slice int, number int, other int, place int, value long"


def _found(row: dict, out: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    cols = [pa.array([row["lang"]] * len(out), pa.string()), pa.array([row["slice"]] * len(out), pa.int32())]
    return pa.RecordBatch.from_arrays(cols + [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], [f.split()[0] for f in FOUND.split(", ")])


def partner(block, blocks, turn: int):
    """The block that a block meets in a round, by the circle method: all meet all in as many rounds as there are others.

    With an odd number of blocks one has a rest each round, which is the partner `blocks`; rounds beyond a language's own
    have no partner.
    """
    even = blocks + blocks % 2
    ring = even - 1
    other = F.pmod(turn - block, ring)
    fixed = F.pmod(turn * (even / 2).cast("int"), ring)
    other = F.when(block == ring, fixed).when(other == block, ring).otherwise(other)
    return F.when((F.lit(turn) < ring) & (other < blocks), other.cast("int"))


def divergence(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source).

    Part `pair`: the item is another source of the language, the value the sum over its kept terms of the floored
    (p-q)^2/(p+q) of both shares. Part `term`: the item is a term that the source has in a greater share than the language,
    the value is the same of that term, and only the best RANKS stay. Ranks go by value, then by the item's bytes.
    Null text, lang and source are empty; repeated rows each count as a document; texts of any length are read whole;
    sources without terms have pairs; a language without kept terms gives value 0; no documents give no rows; other
    columns aren't read. how: when a task hands its counts on (`most`) and how long texts are cut (`piece`).
    """
    scratch, home = Scratch(spark, "divergence"), f"tessera_seats_{uuid.uuid4().hex}"
    counts = scratch.save(count_terms(docs, **how), "counts")
    seated, terms, groups = seats(counts, scratch)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seat = F.xxhash64("lang", "slice", "block")
    try:
        seated.withColumn("seat", seat).write.bucketBy(buckets, "seat").sortBy("seat").saveAsTable(home)
        stay = spark.table(home)
        found = [scratch.save(stay.mapInArrow(at_home, FOUND), "home")]
        rounds = stay.agg(F.coalesce(F.max("blocks"), F.lit(0))).first()[0]
        for turn in range(rounds + rounds % 2 - 1 if rounds > 1 else 0):
            to = partner(F.col("block"), F.col("blocks"), turn)
            peers = stay.withColumn("to", to).filter("to < block").select(F.xxhash64("lang", "slice", "to").alias("seat"), F.col("lang").alias("l"), F.col("slice").alias("s"), F.col("to").alias("b"), F.col("vectors").alias("peer"))
            met = stay.drop("shares").join(peers.hint("merge"), "seat").filter("lang = l AND slice = s AND block = b")
            found.append(scratch.save(met.select("lang", "slice", "n_terms", "vectors", "peer").mapInArrow(meet, FOUND), f"round-{turn}"))
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return scratch.save(_ranked(every, terms, groups), "result")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {home}")


def _ranked(found: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over the slices with the pairs that no slice has, names in place of numbers, and ranks."""
    names = groups.select("lang", "number", "source", "block")
    sums = found.filter("other IS NOT NULL").groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))
    others = names.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    bare = names.join(terms.select("lang").distinct(), "lang", "left_anti").select("lang", "number")
    bare = bare.join(others, "lang").filter("number <> other").select("lang", "number", "other", F.lit(0).cast("long").alias("value"))
    pairs = sums.unionByName(bare).join(others, ["lang", "other"]).select("lang", "number", F.lit("pair").alias("part"), "item", "value")
    best = found.filter("place IS NOT NULL").join(terms.select("lang", "slice", "place", F.col("term").cast("string").alias("item")), ["lang", "slice", "place"])
    best = best.select("lang", "number", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "number", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(best).withColumn("rank", rank).filter(f"part = 'pair' OR rank <= {RANKS}")
    return ranked.join(names, ["lang", "number"]).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and terms of sources over all documents."""
    return divergence(spark, documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY lang, source, term
), k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10
), v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
), q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q FROM k JOIN v USING (lang)
), g AS (SELECT DISTINCT lang, source FROM d
), s AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) c
  ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), p AS (
  SELECT s.lang, s.source, q.term, coalesce(c.n, 0) AS n, q.q, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.v) AS p
  FROM s JOIN v USING (lang) JOIN q USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = q.term
), f AS (
  SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM y WHERE part = 'pair' OR rank <= 10
"""
