"""N-gram Jaccard join: an exact join of word-shingle sets in the Jaccard metric space.

Distance is one minus the Jaccard similarity; texts with equal sets are one class. Two sets within the radius share an
element among the first ones of each set in any common order, so these keys are the regions' doors: documents that
share none are never compared. The order puts elements that a bounded sample shows to be frequent behind all others,
and then recursively those whose doors are still crowded, which affects only cost.

Level 1: every key's smallest document is a pivot. A document is measured against all pivots that lead at least half as
many of its keys as a link needs, which are about four at most, and belongs to the Voronoi region of the nearest one
within the radius. Regions become components without comparing their
members. Level 2: the regions themselves are joined in the same way, through their pivots: where documents of two
regions share a key, the pivots' distance is taken. Level 3: by the triangle inequality two documents of regions P and
Q can be within the radius only if d(P, Q) <= radius + d(x, P) + d(y, Q); just the documents in this window beside the
boundary are replicated to the other region and compared there. Each test is made on whole sets, and no pair within
the radius that matters to the components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, Scratch, components, documents, slices, text_bytes

WORDS = 5
#: two sets are linked from this similarity, in hundredths
PERCENT = 80
RADIUS = 1 - PERCENT / 100
#: documents whose sets show which elements are frequent, and the most elements kept
SAMPLE_DOCUMENTS = 4096
HOT_ELEMENTS = 200_000
#: regions that make a crowd at a key; pairs a row up to which crowds don't matter; times that documents are dealt out
CROWD, PAIRS_A_ROW, TURNS = 100, 8, 3
#: ids that are broadcast to find their texts
BROADCAST_IDS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = _mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15 | 1, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; of all its words, if it has fewer; none without words."""
    n = len(offsets) - 1
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * n
    data = _LOWER[data]
    word = ~_SPACE[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(word & (~before | edge[:-1]))
    if not len(begin):
        return [none] * n
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    size = end - begin
    inside = np.flatnonzero(word)
    at = inside - np.repeat(begin, size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data[inside]] * _powers(int(size.max()))[at], dtype=np.uint64)])
    stop = np.cumsum(size)
    words = _mix(sums[stop] - sums[stop - size] + size.astype(np.uint64))
    first = np.searchsorted(begin, offsets)
    runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        runs += words[j : j + len(runs)] * _FACTOR[j]
    runs = _mix(runs)
    out = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _FACTOR[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(none)
    return out


def prefix_size(n: int) -> int:
    return n - -(-n * PERCENT // 100) + 1 if n else 0


def _sets(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(d, n, a, b, keys) of docs(d, text): size and 128-bit digest of the set, and its first elements."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        often, rank = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                n, a, b, keys = [], [], [], []
                for s in shingle_sets(*text_bytes(batch.column("text"))):
                    n.append(len(s))
                    a.append(_mix(s).sum(dtype=np.uint64))
                    b.append(_mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))
                    if len(often) and len(s):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        late = np.where(often[at] == s, rank[at], 0)
                        if late.any():
                            s = s[np.argsort(late, kind="stable")]
                    keys.append(s[: prefix_size(len(s))].view(np.int64))
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
                digests = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
                cols = [batch.column("d"), pa.array(n, pa.int64()), *digests, pa.ListArray.from_arrays(ends, flat)]
                yield pa.RecordBatch.from_arrays(cols, ["d", "n", "a", "b", "keys"])

    return docs.select("d", "text").mapInArrow(run, "d long, n long, a long, b long, keys array<long>")


def frequent_elements(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements that at least 3 of some SAMPLE_DOCUMENTS different texts have, sorted, and the rank of how many do."""
    total = docs.count()
    h = F.xxhash64("text")
    share = max(1, total // SAMPLE_DOCUMENTS)
    some = docs.filter(F.pmod(h, F.lit(share)) == 0).select(h.alias("h"), "text").dropDuplicates(["h"])
    some = some.orderBy("h").limit(SAMPLE_DOCUMENTS).select("text")

    def run(batches):
        for batch in batches:
            for s in shingle_sets(*text_bytes(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["e"])

    seen = some.mapInArrow(run, "e long").groupBy("e").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3")
    rows = seen.orderBy(F.desc("c"), "e").limit(HOT_ELEMENTS).collect()
    e = np.array([r["e"] for r in rows], np.int64).view(np.uint64)
    c = np.array([r["c"] for r in rows], np.int64)
    order = np.argsort(e)
    return e[order], np.floor(np.log2(np.maximum(c[order], 1))).astype(np.int64)


def texts_of(docs: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, text) of docs(d, text) for the distinct ids; few ids, as counted, are broadcast, else both sides shuffled."""
    ids = scratch.save(ids.distinct(), f"{name}-ids")
    few = ids.count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(ids) if few else ids, docs["d"] == ids["id"]).select("id", "text")
    return scratch.save(found, name)


def _measure(pairs: DataFrame, texts: DataFrame, outside: bool = False) -> DataFrame:
    """(x, y, inter, nx, ny) of pairs(x, y) with texts(id, text); outside: also `out`, the elements of x not in y."""
    left = texts.select(F.col("id").alias("x"), F.col("text").alias("tx"))
    right = texts.select(F.col("id").alias("y"), F.col("text").alias("ty"))
    names = ["x", "y", "inter", "nx", "ny", *["out"] * outside]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "tx"):
                sets = [shingle_sets(*text_bytes(batch.column(c))) for c in ("tx", "ty")]
                inter = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets)]
                cols = [pa.array(v, pa.int64()) for v in (inter, *([len(s) for s in side] for side in sets))]
                if outside:
                    cols.append(pa.array([np.setdiff1d(a, b, assume_unique=True).view(np.int64) for a, b in zip(*sets)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *cols], names)

    joined = pairs.hint("merge").join(left, "x").join(right.hint("merge"), "y").select("x", "y", "tx", "ty")
    return joined.mapInArrow(run, "x long, y long, inter long, nx long, ny long" + ", out array<long>" * outside)


def _linked(inter="inter", nx="nx", ny="ny"):
    union = F.col(nx) + F.col(ny) - F.col(inter)
    return 100 * F.col(inter) >= PERCENT * union


def _distance():
    return 1 - F.col("inter") / (F.col("nx") + F.col("ny") - F.col("inter"))


def _overlap_needed(nx, ny):
    """Common elements that a linked pair of sets has at least, from its sizes."""
    return F.ceil((nx + ny) * (PERCENT / (100 + PERCENT)) - 1e-9)


def _keys_needed(nx, ny):
    """Common keys that a linked pair of sets has at least, from its sizes."""
    overlap = _overlap_needed(nx, ny)
    rest = [n - (n - F.ceil(n * (PERCENT / 100) - 1e-9) + 1) for n in (nx, ny)]
    return F.greatest(F.lit(1), overlap - F.greatest(*rest))


def _sizes_fit(nx, ny):
    return (100 * F.least(nx, ny)) >= (PERCENT * F.greatest(nx, ny))


def _regions(spark: SparkSession, docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], scratch: Scratch, turn: int):
    """Level 1 under one order of elements: sets, links to pivots, place of each document, and regions by key."""
    sets = scratch.save(_sets(docs, hot), f"sets{turn}")
    classes = sets.filter("n > 0").groupBy("a", "b").agg(F.min("d").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    rows = classes.select("id", "n", F.explode("keys").alias("key"))
    key = Window.partitionBy("key")
    doors = rows.withColumns({"g": F.count(F.lit(1)).over(key), "leader": F.min("id").over(key)}).filter("g > 1")
    doors = scratch.save(doors.select("key", "id", "n", "leader"), "doors")
    scratch.tidy()

    # the pivots of each document, and whether it is in their regions; few common keys can't be a near copy's
    led = doors.filter("id <> leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    led = led.filter(2 * F.col("c") >= _keys_needed(F.col("n"), F.col("n")))
    led = scratch.save(led.select(F.col("id").alias("x"), F.col("leader").alias("y")), "led")
    texts = texts_of(docs, _both(led), scratch, "texts1")
    stars = scratch.save(_measure(led, texts).filter(_linked()).select("x", "y", _distance().alias("dist")), f"stars{turn}")
    links = stars.select("x", "y")
    comp = components(spark, links.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch, f"level1-{turn}")
    # of the pivots within the radius the nearest one; of equally near ones the smallest
    region = stars.groupBy("x").agg(F.min(F.struct("dist", "y")).alias("m")).select(F.col("x").alias("id"), F.col("m.y").alias("pivot"), F.col("m.dist").alias("dist"))
    active = doors.select("id").distinct()
    place = active.join(region.hint("merge"), "id", "left").join(comp.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    place = place.select("id", F.coalesce("pivot", "id").alias("pivot"), F.coalesce("dist", F.lit(0.0)).alias("dist"), F.coalesce("component", "id").alias("comp"))
    place = scratch.save(place, f"place{turn}")
    scratch.drop("texts1")

    # keys that documents of different components share
    mixed = doors.select("key", "id", "n").join(place.hint("merge"), "id")
    mixed = mixed.withColumns({"low": F.min("comp").over(key), "high": F.max("comp").over(key)}).filter("low <> high")
    by_region = mixed.groupBy("key", "pivot", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    by_region = scratch.save(by_region, "regions")
    scratch.drop("doors")
    scratch.tidy()
    return sets, links, place, by_region


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("id"))


def crowded_elements(by_region: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys that CROWD regions or more share, at most HOT_ELEMENTS, with ranks as frequent_elements() has them; None if
    joining the regions by their keys would give no more than PAIRS_A_ROW pairs for each row anyway."""
    crowds = by_region.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    total = crowds.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0.0)).alias("pairs")).first()
    if total["pairs"] <= PAIRS_A_ROW * total["rows"]:
        return None
    rows = crowds.filter(F.col("c") >= CROWD).orderBy(F.desc("c"), "key").limit(HOT_ELEMENTS).collect()
    if not rows:
        return None
    rank = [max(1, int(np.log2(max(1, r["c"] * SAMPLE_DOCUMENTS / max(documents, SAMPLE_DOCUMENTS))))) for r in rows]
    return np.array([r["key"] for r in rows], np.int64).view(np.uint64), np.array(rank, np.int64)


def class_links(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sets (d, n, a, b) of the rows of docs(d, text), and links (x, y) between the smallest ids of classes.

    The links join exactly the classes that a chain of pairs within the radius joins. Where a key turns out to be shared
    by a crowd of regions, it goes behind the other elements and the documents are dealt out again by what else they
    have, until no crowd is left that can be avoided.
    """
    hot, turn = frequent_elements(docs), 0
    while True:
        sets, links, place, by_region = _regions(spark, docs, hot, scratch, turn)
        crowded = crowded_elements(by_region, sets.count())
        new = None if crowded is None else ~np.isin(crowded[0], hot[0])
        turn += 1
        if new is None or not new.any() or turn == TURNS:
            break
        elements = np.concatenate([hot[0], crowded[0][new]])
        order = np.argsort(elements)
        hot = elements[order], np.concatenate([hot[1], crowded[1][new]])[order]
        scratch.drop(*(f"{name}{turn - 1}" for name in ("sets", "stars", "place")), "regions")

    # level 2: the regions themselves
    one, two = by_region.alias("one"), by_region.alias("two")
    met = one.join(two.hint("merge"), F.col("one.key") == F.col("two.key")).filter("one.pivot < two.pivot AND one.comp <> two.comp")
    met = met.filter("100 * one.most >= %d * two.least AND 100 * two.most >= %d * one.least" % (PERCENT, PERCENT))
    met = met.groupBy(F.col("one.pivot").alias("x"), F.col("two.pivot").alias("y")).agg(
        F.count(F.lit(1)).alias("c"), F.min("one.least").alias("x0"), F.max("one.most").alias("x1"),
        F.min("two.least").alias("y0"), F.max("two.most").alias("y1"),
    )
    # what a pair needs is concave in its sizes, so the least is at a corner; 2 for rounding
    corners = [_keys_needed(F.col(i), F.col(j)) for i in ("x0", "x1") for j in ("y0", "y1")]
    met = met.filter(F.col("c") >= F.least(*corners) - 2)
    met = scratch.save(met.select("x", "y"), "met")
    texts = texts_of(docs, _both(met), scratch, "texts2")
    measured = scratch.save(_measure(met, texts).withColumn("dist", _distance()), "measured")
    links = links.unionByName(measured.filter(_linked()).select("x", "y"))
    scratch.drop("texts2", "regions")
    window = _window_links(docs, measured.filter(~_linked()), place, scratch)
    links = scratch.save(links.unionByName(window), "links")
    scratch.tidy()
    return sets, links


def _window_links(docs: DataFrame, measured: DataFrame, place: DataFrame, scratch: Scratch) -> DataFrame:
    """Level 3: links between documents of two regions whose pivots aren't linked, by the triangle inequality.

    The documents of the smaller region are measured against the larger one's pivot P; those in the window around P
    are set against the members of its region. Two sets X and Y share at most min(|X and P|, |Y and P|) elements of P,
    so what is lacking to a link they must share outside P: pairs meet through such elements, or, if nothing is
    lacking, through their sizes.
    """
    regions = place.groupBy("pivot").agg(F.max("dist").alias("reach"), F.count(F.lit(1)).alias("members"))
    near = measured.select("x", "y", "dist").join(regions.toDF("x", "rx", "mx"), "x").join(regions.toDF("y", "ry", "my"), "y")
    near = near.filter((F.col("rx") + F.col("ry") > 0) & (F.col("dist") <= RADIUS + F.col("rx") + F.col("ry") + 1e-9))
    swap = (F.col("my") > F.col("mx")) | ((F.col("my") == F.col("mx")) & (F.col("ry") > F.col("rx")))
    near = near.select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("p"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("q"),
        F.when(swap, F.col("ry")).otherwise(F.col("rx")).alias("reach"),
    )
    near = scratch.save(near, "near")
    of = place.select("id", "pivot", "comp")
    outer = near.join(of, F.col("q") == F.col("pivot")).select(F.col("id").alias("x"), F.col("p").alias("y"), "reach").distinct()
    outer = scratch.save(outer, "outer")
    inner = near.select("p").distinct().join(of, F.col("p") == F.col("pivot")).filter("id <> p").select(F.col("id").alias("x"), F.col("p").alias("y"))
    inner = scratch.save(inner, "inner")
    ids = outer.select("x", "y").unionByName(inner).select(F.explode(F.array("x", "y")).alias("id"))
    texts = texts_of(docs, ids, scratch, "texts3")
    sized = ["x", "y", "inter", "nx", "ny", "out"]
    outer = scratch.save(_measure(outer.select("x", "y"), texts, True).select(*sized).join(outer, ["x", "y"]), "outer3")
    inner = scratch.save(_measure(inner, texts, True).select(*sized), "inner3")
    links = outer.filter(_linked()).select("x", "y")
    comp = place.select(F.col("id").alias("x"), "comp")
    member = inner.join(comp, "x").select(F.col("x").alias("a"), F.col("y").alias("p"), F.col("inter").alias("sa"), F.col("nx").alias("na"), F.col("ny").alias("np"), F.col("out").alias("oa"), F.col("comp").alias("ca"))
    beside = outer.filter(~_linked() & (_distance() <= RADIUS + F.col("reach") + 1e-9)).join(comp, "x")
    beside = beside.select(F.col("x").alias("b"), F.col("y").alias("p"), F.col("inter").alias("sb"), F.col("nx").alias("nb"), F.col("out").alias("ob"), F.col("comp").alias("cb"))
    lacking = _overlap_needed(F.col("na"), F.col("nb")) - F.least("sa", "sb")
    fits = (F.col("ca") != F.col("cb")) & _sizes_fit(F.col("na"), F.col("nb"))
    # nothing lacking: only members smaller than the pivot can have that
    direct = member.filter("na < np").drop("oa").join(beside.drop("ob"), "p").filter(fits & (lacking <= 0)).select("a", "b")
    through = member.select("a", "p", "sa", "na", "ca", F.explode("oa").alias("e"))
    through = through.join(beside.select("b", "p", "sb", "nb", "cb", F.explode("ob").alias("e")), ["p", "e"]).filter(fits)
    through = through.groupBy("a", "b", "p").agg(F.count(F.lit(1)).alias("c"), F.first(lacking).alias("l")).filter("c >= l")
    pairs = direct.unionByName(through.select("a", "b")).distinct().select(F.col("a").alias("x"), F.col("b").alias("y"))
    found = scratch.save(_measure(scratch.save(pairs, "beside"), texts).filter(_linked()).select("x", "y"), "window")
    scratch.drop("texts3", "inner3", "outer")
    return links.unionByName(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text).

    Null texts, and texts without words, have an empty set and are linked with nothing. Rows that repeat an id are one
    node: their links count together. A null id comes after all others. An empty table gives no rows; other columns
    are not read.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), "text")
    sets, links = class_links(spark, rows, scratch)
    comp = components(spark, links.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch, "all")
    classes = sets.filter("n > 0").groupBy("a", "b").agg(F.min("d").alias("id"))
    classes = classes.join(comp.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    classes = scratch.save(classes.select("a", "b", F.coalesce("component", "id").alias("component")), "classes")
    out = sets.select("d", "n", "a", "b").join(classes.hint("merge"), ["a", "b"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("d"))
    null = F.lit(NULL_ID)
    return out.select(F.nullif("d", null).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, null).alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir), Scratch(spark, "jaccard"))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays, with its columns as they were."""
    scratch = Scratch(spark, "jaccard")
    found = near_duplicates(spark, docs, scratch).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = scratch.save(found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__d")).distinct(), "gone")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("__d"))
    return keyed.join(gone.hint("merge"), "__d", "left_anti").select("row.*")
