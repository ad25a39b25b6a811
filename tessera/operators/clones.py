"""Clone detection over lines and token windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lots import LOTS, lots
from .graphs import cut

# fixed values: what a run of tokens must have to count
WORDS_AT_ONCE = 1 << 17  # words that a task holds hashes of at a time, if no file has more
DEFAULTS = {"least_tokens": 50, "least_lines": 5, "threshold_percent": 0.0, "skip_local": False}


def fragment_tokens(text: Column) -> Column:
    """Tokens of a text that no parser takes: runs of word signs and single other signs, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), 0)


def without_types(tokens: DataFrame) -> DataFrame:
    """tokens(file, pos, kind, text) without those of types, with places counted anew: typed and untyped files match."""
    kept = tokens.filter("kind <> 'type'")
    return kept.withColumn("pos", (F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1).cast("long"))


def by_section(words: DataFrame) -> DataFrame:
    """words(doc_id, section, w) as (doc_id, w) with a unit of its own for each section, so that no run crosses one."""
    return words.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("section").cast("string")).alias("doc_id"), "w")


def largest_groups(groups: DataFrame, members: DataFrame, scope: DataFrame, top: int) -> DataFrame:
    """The `top` groups(group, length, instances) with a member, members(group, file), in scope(file), by what they repeat."""
    inside = members.join(scope.select("file").distinct(), "file", "left_semi").select("group").distinct()
    return groups.join(inside, "group", "left_semi").orderBy(F.desc(F.col("length") * (F.col("instances") - 1)), "group").limit(top)


def local_only(groups: DataFrame, members: DataFrame) -> DataFrame:
    """groups(group, ...) all of whose members(group, file) stand in one folder: what skip_local leaves out."""
    place = F.regexp_replace("file", "/?[^/]*$", "")
    one = members.groupBy("group").agg(F.countDistinct(place).alias("n")).filter("n = 1").select("group")
    return groups.join(one, "group", "left_semi")


def clone_groups(lines: DataFrame, least_files: int = 2) -> DataFrame:
    """(line, files, instances) of lines(doc_id, pos, line) that stand in several documents."""
    return lines.groupBy("line").agg(F.countDistinct("doc_id").alias("files"), F.count(F.lit(1)).alias("instances")).filter(F.col("files") >= least_files)


def clone_families(lines: DataFrame) -> DataFrame:
    """(first_file, files, family, groups): for each set of documents, how many lines stand in just these.

    A set is known by two sums over hashes of its ids and its size, so that a line in very many documents costs partial
    sums, not a list: family is their hash, first_file the smallest id.
    """
    each = lines.select("line", "doc_id").distinct()
    part = lambda salt: F.sum(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 40)))
    sets = each.groupBy("line").agg(F.min("doc_id").alias("first_file"), F.count(F.lit(1)).alias("files"), part(1).alias("a"), part(2).alias("b")).filter("files > 1")
    return sets.groupBy("first_file", "files", F.xxhash64("a", "b").alias("family")).agg(F.count(F.lit(1)).alias("groups"))


def duplication_share(lines: DataFrame) -> DataFrame:
    """One row: lines, those that stand in another document too, and their percent."""
    n = lines.groupBy("line").agg(F.countDistinct("doc_id").alias("files"), F.count(F.lit(1)).alias("n"))
    out = n.agg(F.sum("n").alias("lines"), F.sum(F.when(F.col("files") > 1, F.col("n")).otherwise(0)).alias("duplicated"))
    return out.withColumn("percent", F.round(100 * F.col("duplicated") / F.col("lines"), 2))


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, where a small table comes in fewer files than there are; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def window_hashes(words: DataFrame, width: int, apart: bool = False, marked: bool = False) -> DataFrame:
    """(doc_id, pos, h) of words(doc_id, w): a hash of each window of `width` words, in time linear in the text.

    apart: without the windows that begin less than `width` after an equal one of their file, as text that repeats
    itself with a short period isn't a copy of itself. marked: of these, the ones that some window kept before them lies
    behind whose equal one stay, with that one's place as `before`, which is null for the others.

    The words' hashes are summed with powers of an odd number, so that a window's hash is a difference of two sums,
    brought back by the inverse power. Words come to Python as their hashes, and files are taken few at a time.
    """

    def parts(batches):
        for batch in batches:
            ends = np.cumsum(np.array(batch.column("w").value_lengths().fill_null(0), np.int64))
            low = 0
            while low < batch.num_rows:
                upto = (ends[low - 1] if low else 0) + WORDS_AT_ONCE
                high = max(low + 1, int(np.searchsorted(ends, upto, side="right")))
                yield batch.slice(low, high - low)
                low = high

    def run(batches):
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        for batch in parts(batches):
            column = batch.column("w")
            h = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = np.array(column.value_lengths().fill_null(0), np.int64)
            powers, back = (np.full(len(h) + 1, x, np.uint64) for x in (base, inverse))
            powers[0] = back[0] = 1
            powers, back = np.cumprod(powers), np.cumprod(back)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[: len(h)])])
            total = max(0, len(h) - width + 1)
            value = (sums[width : width + total] - sums[:total]) * back[:total]
            value ^= value >> np.uint64(31)
            ends = np.cumsum(n)
            count = np.maximum(n - width + 1, 0)
            doc = np.repeat(np.arange(len(n)), count)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(ends - n, count) + pos
            if apart:
                each = value[at] ^ doc.astype(np.uint64) * base  # rows are in order of file and place, and stay so among equals
                order = np.argsort(each, kind="stable")
                near = (each[order[1:]] == each[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (pos[order[1:]] - pos[order[:-1]] < width)
                before = np.full(len(doc), -1)
                before[order[1:][near]] = pos[order[:-1][near]]
                keep = before < 0
                if marked and len(keep):
                    last = np.maximum.accumulate(np.where(keep, np.arange(len(keep)), 0))  # a file's first window is kept
                    keep |= pos[last] > before
                doc, pos, at, before = doc[keep], pos[keep], at[keep], before[keep]
            cols = [batch.column("doc_id").take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(value[at].view(np.int64))]
            cols += [pa.array(before.astype(np.int32), mask=before < 0)] if marked else []
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "pos", "h", "before"][: len(cols)])

    kind = words.schema["doc_id"].dataType.simpleString()
    hashed = dealt(words.select("doc_id", "w")).select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    return hashed.mapInArrow(run, f"doc_id {kind}, pos int, h long" + (", before int" if marked else ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, windows, repeated): windows of `width` words of a text, and those whose words stand twice anywhere.

    Hashes are shuffled once; files without a repeated window can be dropped by repeated > 0.
    """
    w = window_hashes(docs.select("doc_id", words_of(F.col("text")).alias("w")), max(width, 1))
    again = F.count(F.lit(1)).over(Window.partitionBy("h")) > 1
    found = w.withColumn("again", again).groupBy("doc_id")
    return found.agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(F.col("again"), 1)).alias("repeated"))


def near_focus(docs: DataFrame, focus: DataFrame, least_words: int) -> DataFrame:
    """docs(doc_id) that share a window with one of focus(doc_id), these included; all of them if the focus has no window.

    Windows have `least_words` words, 7 at most.
    """
    focus, width = focus.select("doc_id").distinct(), min(max(least_words, 1), 7)
    hashed = lambda d: window_hashes(d.select("doc_id", words_of(F.col("text")).alias("w")), width)
    of_focus = cut(hashed(docs.join(focus, "doc_id", "left_semi")).select("h").distinct())
    if of_focus.isEmpty():
        return docs.select("doc_id").distinct()
    return hashed(docs).join(of_focus, "h", "left_semi").select("doc_id").distinct()


def instance_groups(runs: DataFrame, focus: DataFrame, least: int) -> DataFrame:
    """(of_doc, of_first, length, instances, files) of runs(doc_id, first, last, of_doc, of_first): groups of `least`
    words or more with an instance in focus(doc_id), the home one among them; groups of a single file are left out."""
    length = F.col("last") - F.col("first") + 1
    here = runs.filter(length >= least).select("of_doc", "of_first", length.alias("length"), "doc_id")
    every = here.unionByName(here.select("of_doc", "of_first", "length", F.col("of_doc").alias("doc_id")).distinct())
    every = every.join(focus.select("doc_id", F.lit(True).alias("f")).distinct(), "doc_id", "left")
    found = every.groupBy("of_doc", "of_first", "length").agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("doc_id").alias("files"), F.bool_or(F.coalesce("f", F.lit(False))).alias("f"))
    return found.filter("f AND files > 1").drop("f")


def trimmed(first: Column, length: Column, starts_with_semicolon: Column, least: int) -> Column:
    """(first, length) of a run without a leading semicolon, or null if it is then too short."""
    cut = F.coalesce(starts_with_semicolon, F.lit(False)).cast("int")
    return F.when(length - cut >= least, F.struct((first + cut).alias("first"), (length - cut).alias("length")))


#: fixed values of near_misses: 64-bit parts of a set's bitmap, words of a block of sets, how many sets of a block and
#: how many pairs (if no set has more) are looked at at a time, what part of the sets has a word whose frequency counts
BITMAP_PARTS, BLOCK_WORDS, WORD_GROUP, PAIRS_AT_ONCE, FREQUENT = 16, 1 << 19, 512, 1 << 19, 2048


def _blocks(sets: DataFrame, blocks: int, often: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """sets(id, w), dealt out to so many blocks, a row each: ids, sizes, known, words, ordered, bitmaps, index.

    known: the block's words in order; words: their numbers there, set by set, rare ones first; ordered: the same ones of
    each set in order; index: places of the words by which a set meets smaller ones, in order of word and size of the set;
    often: frequent words in order, and in how many sets they stand.
    """
    words, counts = often

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                sets = batch.column("s")[row].values
                listed = sets.field("w")
                w, z = listed.flatten().to_numpy(zero_copy_only=False), np.array(listed.value_lengths(), np.int64)
                of = np.repeat(np.arange(len(z)), z)
                n = np.zeros(len(w), np.int64)
                if len(words):
                    at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                    n = np.where(words[at] == w, counts[at], 0)
                w = w[np.lexsort((w, n, of))]
                bit = (w.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                bit = (bit % np.uint64(64 * BITMAP_PARTS)).astype(np.int64)
                maps = np.zeros(len(z) * BITMAP_PARTS, np.uint64)
                np.bitwise_or.at(maps, of * BITMAP_PARTS + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
                known, code = np.unique(w, return_inverse=True)
                ordered = np.sort(of * len(known) + code) - of * len(known)
                place = np.arange(len(w)) - np.repeat(np.cumsum(z) - z, z)
                first = np.flatnonzero(place < (z + (-z * percent // 100) + 1)[of])
                index = first[np.lexsort((z[of[first]], code[first]))]
                each = [pa.array([x], pa.list_(kind)) for x, kind in ((z, pa.int64()), (known, pa.int64()), (code.astype(np.int32), pa.int32()), (ordered.astype(np.int32), pa.int32()), (maps.view(np.int64), pa.int64()), (index.astype(np.int32), pa.int32()))]
                ids = sets.field("id")
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *each], ["ids", "sizes", "known", "words", "ordered", "maps", "index"])

    kind = sets.schema["id"].dataType.simpleString()
    dealt_out = sets.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "w")).alias("s"))
    return dealt_out.select("s").mapInArrow(run, f"ids array<{kind}>, sizes array<long>, known array<long>, words array<int>, ordered array<int>, maps array<long>, index array<int>")


def _pairs_of_blocks(percent: int):
    """Of blocks a and b of _blocks, the pairs (a, b, shared, total) of a set of a and one of b that comes behind it by size and id."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                take = lambda c: batch.column(c)[row].values  # noqa: E731, B023
                (ids_a, za, known_a, wa, maps_a), (ids_b, zb, known, code_b, maps_b) = ([take(f"{s}_ids"), *(take(f"{s}_{c}").to_numpy(zero_copy_only=False) for c in ("sizes", "known", "words", "maps"))] for s in "ab")
                order_a, order_b = (x.to_numpy(zero_copy_only=False) for x in (ids_a, ids_b))
                maps_a, maps_b = (m.view(np.uint64).reshape(-1, BITMAP_PARTS) for m in (maps_a, maps_b))
                start_a, start_b = np.cumsum(za) - za, np.cumsum(zb) - zb
                of_a, of_b = np.repeat(np.arange(len(za)), za), np.repeat(np.arange(len(zb)), zb)
                place_a, place_b = np.arange(len(wa)) - start_a[of_a], np.arange(len(code_b)) - start_b[of_b]
                # words of a by their numbers in b
                at = np.minimum(np.searchsorted(known, known_a), len(known) - 1)
                code_a = np.where(known[at] == known_a, at, -1)[wa]
                index, ordered = (take(f"b_{c}").to_numpy(zero_copy_only=False) for c in ("index", "ordered"))
                wide = max(int(zb.max()), int(za.max()) * 100 // percent) + 2
                post = code_b[index].astype(np.int64) * wide + zb[of_b[index]]
                # the set that isn't the larger one needs fewer of its words, and meets sizes from its own on
                entry = np.flatnonzero((place_a < (za + (-za * 2 * percent // (100 + percent)) + 1)[of_a]) & (code_a >= 0))
                size = za[of_a[entry]]
                low = np.searchsorted(post, code_a[entry] * wide + size)
                count = np.searchsorted(post, code_a[entry] * wide + size * 100 // percent, side="right") - low
                entry, low, count = (x[count > 0] for x in (entry, low, count))
                by_set = of_a[entry]
                ends = np.flatnonzero(np.concatenate([by_set[1:] != by_set[:-1], [True]])) + 1 if len(entry) else np.zeros(0, np.int64)
                upto = np.cumsum(count)
                inside = ordered + of_b * len(known)
                begin = 0
                while begin < len(entry):
                    most = (upto[begin - 1] if begin else 0) + PAIRS_AT_ONCE
                    fits = int(np.searchsorted(upto[ends - 1], most, side="right"))
                    here = int(np.searchsorted(ends, begin, side="right"))
                    end = int(ends[max(here, min(fits, here + WORD_GROUP) - 1)])
                    some = count[begin:end]
                    x = np.repeat(entry[begin:end], some)
                    y = index[np.arange(len(x)) + np.repeat(low[begin:end] - (np.cumsum(some) - some), some)]
                    begin = end
                    i, j = of_a[x], of_b[y]
                    left = np.minimum(za[i] - place_a[x], zb[j] - place_b[y])
                    kept = left * (100 + percent) >= percent * (za[i] + zb[j])
                    pair = np.unique(i[kept] * len(zb) + j[kept])
                    i, j = pair // len(zb), pair % len(zb)
                    kept = (za[i] < zb[j]) | (order_a[i] < order_b[j])
                    i, j = i[kept], j[kept]
                    # a bit that only one of two has is a word that the other lacks
                    for step in range(0, BITMAP_PARTS, 4):
                        if step == 0:
                            lack_a, lack_b = (np.zeros(len(i), np.int64) for _ in range(2))
                        m, n = maps_a[i, step : step + 4], maps_b[j, step : step + 4]
                        lack_a += np.bitwise_count(m & ~n).sum(axis=1, dtype=np.int64)
                        lack_b += np.bitwise_count(n & ~m).sum(axis=1, dtype=np.int64)
                        kept = np.minimum(za[i] - lack_a, zb[j] - lack_b) * (100 + percent) >= percent * (za[i] + zb[j])
                        i, j, lack_a, lack_b = i[kept], j[kept], lack_a[kept], lack_b[kept]
                    if not len(i):
                        continue
                    each = np.repeat(np.arange(len(i)), za[i])
                    code = code_a[np.arange(len(each)) + np.repeat(start_a[i] - (np.cumsum(za[i]) - za[i]), za[i])]
                    key = code + j[each] * len(known)
                    found = (code >= 0) & (inside[np.minimum(np.searchsorted(inside, key), len(inside) - 1)] == key)
                    shared = np.bincount(each[found], minlength=len(i))
                    total = za[i] + zb[j] - shared
                    kept = 100 * shared >= percent * total
                    cols = [ids_a.take(pa.array(i[kept])), ids_b.take(pa.array(j[kept])), pa.array(shared[kept]), pa.array(total[kept])]
                    yield pa.RecordBatch.from_arrays(cols, ["a", "b", "shared", "total"])

    return run


def near_misses(spans: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b, shared, total) of spans(id, w): pairs whose sets of words are equal to `percent` hundredths, but not in all.

    Of a set's words in one common order, rare ones first, two such sets meet in a first common word, behind which each has
    enough words left for what they must share; the set that isn't the larger one needs fewer of its first words for that.
    Sets that meet are told apart by bitmaps of their words, and what is left is compared by its words. Sets are dealt out
    to blocks of BLOCK_WORDS words, written once; each pair of blocks is read from there and worked on in memory, so
    nothing that grows with the number of pairs is written but the result. Words are known by 64-bit hashes. Spans with
    equal sets are one: the smallest id stands for them.
    """
    hashed = F.array_sort(F.array_distinct(F.transform(F.array_compact("w"), lambda x: F.xxhash64(x))))
    sets = cut(spans.select("id", hashed.alias("w")).groupBy("w").agg(F.min("id").alias("id"))).filter("size(w) > 0")
    total = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("w")).alias("words")).first()
    n, words = total["n"], total["words"] or 0
    # words that stand in fewer sets count as equally rare, so that what comes to the driver is at most FREQUENT times a set's words
    often = sets.select(F.explode("w").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, n / FREQUENT)).orderBy("x").toArrow()
    often = tuple(often.column(c).to_numpy() for c in ("x", "n"))
    blocks = cut(_blocks(sets, max(1, -(-words // BLOCK_WORDS)), often, percent))
    side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns])
    kind = spans.schema["id"].dataType.simpleString()
    met = side("a").drop("a_index", "a_ordered").hint("shuffle_replicate_nl").crossJoin(side("b"))
    found = met.mapInArrow(_pairs_of_blocks(percent), f"a {kind}, b {kind}, shared long, total long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "total")


def tokens(text: Column, mode: str = "mild") -> Column:
    """Words and single signs of a text, normalised: strict keeps all, mild lower-cases, weak blinds quoted strings,
    semantic also blinds names and numbers."""
    found = F.regexp_extract_all(text, F.lit(r""""[^"\n]*"|'[^'\n]*'|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_ \t\r\n]"""), 0)
    if mode == "strict":
        return found
    blind = lambda x, kind, sign: F.when(x.rlike(kind), F.lit(sign)).otherwise(x)
    found = F.transform(found, F.lower)
    if mode in ("weak", "semantic"):
        found = F.transform(found, lambda x: blind(x, "^[\"'].", "$s"))
    if mode == "semantic":
        found = F.transform(found, lambda x: blind(blind(x, "^[a-z_]", "$n"), "^[0-9]", "$0"))
    return found


def first_copies(words: DataFrame, width: int) -> DataFrame:
    """(doc_id, first, last, of_doc, of_first): maximal runs of words that stand earlier, at their earliest place.

    words(doc_id, w): each window of `width` words is tied to the smallest (doc_id, position) of its hash, by a minimum
    over one shuffle, so the rows stay linear in the text whatever the number of copies; runs on one diagonal are merged.
    """
    group = Window.partitionBy("h")
    at = window_hashes(words, width)
    hit = at.withColumns({"home": F.min(F.struct("doc_id", "pos")).over(group), "n": F.count(F.lit(1)).over(group)})
    hit = hit.filter("n > 1 AND (doc_id <> home.doc_id OR pos <> home.pos)")
    hit = hit.select("doc_id", "pos", F.col("home.doc_id").alias("of_doc"), (F.col("pos") - F.col("home.pos")).alias("shift"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    same = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("of_doc").over(w) == F.col("of_doc")) & (F.lag("shift").over(w) == F.col("shift"))
    hit = hit.withColumn("new", F.when(same, 0).otherwise(1))
    hit = hit.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = hit.groupBy("doc_id", "run").agg(F.min("pos").alias("first"), (F.max("pos") + width - 1).alias("last"), F.min("of_doc").alias("of_doc"), F.min(F.col("pos") - F.col("shift")).alias("of_first"))
    return runs.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("first", "last", "of_doc", "of_first")])


def _all_same(c: str, of: str = "true") -> Column:
    """Whether column c has one value, and no null, in all rows of a group for which `of` holds."""
    x = F.expr(f"CASE WHEN {of} THEN {c} END")
    return (F.count(x) == F.count_if(F.expr(of))) & (F.min(x) == F.max(x))


def _stretches(words: DataFrame, width: int, whole: bool) -> DataFrame:
    """(doc_id, run, at, stop, sym, before): the repeated windows of each file in stretches that can't be told apart.

    A window class that always goes on to the same class, which always comes from it, makes one stretch with it, as in a
    compacted graph of windows; a stretch is named by its first class and goes from window `at` to before `stop`. Stretches
    of one run follow on each other. whole: stretches of windows that overlap an equal one, too, with the last place of
    such an equal one as `before`; what can be told apart is known from the others alone.
    """
    places = window_hashes(words, width, apart=True, marked=whole)
    places = places if whole else places.withColumn("before", F.lit(None).cast("int"))
    often = places.withColumn("n", F.count_if(F.col("before").isNull()).over(Window.partitionBy("h"))).filter("n > 1")
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = lambda shift, c: F.when(F.lag("pos", shift).over(w) == F.col("pos") - shift, F.lag(c, shift).over(w))
    at = cut(often.select("doc_id", "pos", "h", "before", F.when(F.col("before").isNull(), F.col("h")).alias("own")))
    beside = at.select("doc_id", "pos", "h", "before", near(1, "h").alias("prev"), near(1, "own").alias("own_prev"), near(-1, "own").alias("own_next"))
    facts = beside.filter("before IS NULL").groupBy("h").agg(_all_same("own_prev").alias("one_prev"), _all_same("own_next").alias("one_next"))
    told = beside.join(facts, "h").select("doc_id", "pos", "h", "before", "prev", "one_prev", near(1, "one_next").alias("from_one"))
    joined = F.col("prev").isNotNull() & F.col("one_prev") & F.col("from_one")
    sums = w.rowsBetween(Window.unboundedPreceding, 0)
    told = told.select("doc_id", "pos", "h", "before", (~joined).cast("int").alias("new"), F.col("prev").isNull().cast("int").alias("apart"))
    told = told.select("doc_id", "pos", "h", "before", F.sum("new").over(sums).alias("part"), F.sum("apart").over(sums).alias("run"))
    parts = told.groupBy("doc_id", "run", "part").agg(F.min("pos").alias("at"), (F.max("pos") + 1).alias("stop"), F.min_by("h", "pos").alias("sym"), F.max("before").alias("before"))
    return parts.drop("part")


def _in_task():
    """Functions that tasks need, made here so that they go to Python with what uses them: names' hashes, arrays, ends."""

    def sequence_hashes(sym: np.ndarray):
        """A function of places i and e: hashes of the names sym[i:e], the same for equal names anywhere."""
        step, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        powers, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(sym), x, np.uint64)])) for x in (step, back))
        names = sym.view(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((names ^ (names >> np.uint64(29))) * powers[: len(sym)])])

        def hashes(i, e):
            key = (sums[e] - sums[i]) * inverse[i]
            return ((key ^ (key >> np.uint64(32))) * step).view(np.int64)

        return hashes

    def flat(batch, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
        """The batch's arrays of these columns as one each, and where each row's begin."""
        n = np.array(batch.column(names[0]).value_lengths(), np.int64)
        return (*(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in names), np.cumsum(n) - n, n)

    def ends_of(place: dict[str, np.ndarray], sym: np.ndarray, at: np.ndarray, stop: np.ndarray, here: np.ndarray, step: int) -> list[pa.Array]:
        """Hashes and sizes of the sequences from `here` on that are 1 to WAYS - 1 steps longer than place's length, as far as they go."""
        e = (here + place["length"])[:, None] + np.arange(1, WAYS) * step
        fits = e <= (here + place["lim"])[:, None]
        upto = pa.array(np.concatenate([[0], np.cumsum(fits.sum(axis=1))]).astype(np.int32))
        i, e = np.repeat(here, fits.sum(axis=1)), e[fits]
        hashes = place["hashes"](i, e)
        return [pa.ListArray.from_arrays(upto, pa.array(x)) for x in (hashes, stop[e - 1] - at[i])]

    return sequence_hashes, flat, ends_of


def _overlapping(runs: DataFrame) -> DataFrame:
    """(doc_id, first, size, key) of every sequence of stretches of runs(doc_id, at, stop, sym, before) that holds one that
    overlaps an equal one. It doesn't begin with such a stretch, nor does it hold one along with its equal one."""
    sequence_hashes, _, _ = _in_task()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at, stop, sym, before = (batch.column(c)[row].values.to_numpy() for c in ("at", "stop", "sym", "before"))
                n, hashes = len(sym), sequence_hashes(sym)
                over = np.concatenate([[0], np.cumsum(before >= 0)])
                nearest = np.minimum.accumulate(np.where(before >= 0, np.arange(n), n)[::-1])[::-1]
                end, k = np.full(n, n), 0
                for low in range(n if over[n] else 0):
                    while k < n and (k <= low or before[k] < at[low]):
                        k += 1
                    end[low] = k
                count = np.where(before < 0, np.maximum(end - nearest, 0), 0)
                upto = np.cumsum(count)
                low = 0
                while low < n:
                    high = max(low + 1, int(np.searchsorted(upto, upto[low] - count[low] + 200_000, side="right")))
                    some = count[low:high]
                    i = np.repeat(np.arange(low, min(high, n)), some)
                    j = nearest[i] + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
                    low = high
                    cols = [batch.column("doc_id").take(pa.array(np.full(len(i), row))), pa.array(at[i]), pa.array(stop[j] - at[i]), pa.array(hashes(i, j + 1))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "first", "size", "key"])

    kind = runs.schema["doc_id"].dataType.simpleString()
    some = runs.filter(F.exists("before", lambda x: x >= 0)).select("doc_id", "at", "stop", "sym", "before")
    return some.mapInArrow(run, f"doc_id {kind}, first long, size long, key long")


#: ends of a place that a round of _maximal looks at
WAYS = 16
_PLACE = "rid long, i int, lim int, first long, root long, key long, length int, size long, child long, prev long"
_ENDS = ", ends array<long>, sizes array<long>"


def _begun(runs: DataFrame, step: int, last: bool) -> DataFrame:
    """The places of the runs that can grow by `step`, but not by WAYS of it, with their ends: the first round they are in."""
    sequence_hashes, flat, ends_of = _in_task()

    def run(batches):
        for batch in batches:
            at, stop, sym, before, begin, n = flat(batch, ("at", "stop", "sym", "before"))
            hashes, over, of = sequence_hashes(sym), before >= 0, np.repeat(np.arange(len(n)), n)
            final = (begin + n)[of]
            nearest = np.minimum(np.minimum.accumulate(np.where(over, np.arange(len(sym)), len(sym))[::-1])[::-1], final) if len(sym) else final
            lim = nearest - np.arange(len(sym))
            every = np.flatnonzero(~over & ((lim - 1 >= step) | last) & (lim - 1 < step * WAYS))
            for some in (every[low : low + 8192] for low in range(0, len(every), 8192)):
                alone = (some == begin[of[some]]) | over[some - 1]
                place = {"length": np.ones(len(some), np.int64), "lim": lim[some], "hashes": hashes}
                prev = pa.array(sym[some - 1], mask=alone)
                cols = [batch.column("rid").take(pa.array(of[some])), pa.array((some - begin[of[some]]).astype(np.int32)), pa.array(lim[some].astype(np.int32)), pa.array(at[some]), pa.array(sym[some])]
                cols += [pa.array(hashes(some, some + 1)), pa.array(np.ones(len(some), np.int32)), pa.array(stop[some] - at[some]), pa.nulls(len(some), pa.int64()), prev]
                yield pa.RecordBatch.from_arrays([*cols, *ends_of(place, sym, at, stop, some, step)], [x.split()[0] for x in (_PLACE + _ENDS).split(", ")])

    return runs.select("rid", "at", "stop", "sym", "before").mapInArrow(run, _PLACE + _ENDS)


def _carried(places: DataFrame, runs: DataFrame, step: int) -> DataFrame:
    """places of the rounds before, with their ends."""
    names = [x.split()[0] for x in _PLACE.split(", ")]
    sequence_hashes, flat, ends_of = _in_task()

    def run(batches):
        for batch in batches:
            at, stop, sym, begin, _ = flat(batch, ("at", "stop", "sym"))
            hashes, listed = sequence_hashes(sym), batch.column("places")
            of = np.repeat(np.arange(len(begin)), np.array(listed.value_lengths(), np.int64))
            every = pa.RecordBatch.from_struct_array(listed.flatten())
            for low in range(0, len(of), 8192):
                some = every.slice(low, 8192)
                place = {c: np.array(some.column(c), np.int64) for c in ("length", "lim", "i")} | {"hashes": hashes}
                ends = ends_of(place, sym, at, stop, begin[of[low : low + 8192]] + place["i"], step)
                yield pa.RecordBatch.from_arrays([*some.columns, *ends], [*names, "ends", "sizes"])

    listed = places.groupBy("rid").agg(F.collect_list(F.struct(*names)).alias("places"))
    return listed.join(runs.select("rid", "at", "stop", "sym"), "rid").select("at", "stop", "sym", "places").mapInArrow(run, _PLACE + _ENDS)


def _descend(step: int, last: bool):
    """Of all places with one root, and their ends: places that share an end go there, and one stays for all as the child's.

    At last, the groups form the tree of common beginnings: (rid, first, size, key) of the groups that more than one name
    comes before, with all places below them.
    """
    _, flat, _ = _in_task()

    def moved(batches):
        batches = list(batches)
        if not batches:
            return None
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()
        if not batch:
            return None
        batch = batch[0]
        c = {x: np.array(batch.column(x), np.int64) for x in ("rid", "i", "lim", "first", "root", "key", "length", "size")}
        c |= {x: np.array(batch.column(x).fill_null(0), np.int64) for x in ("child", "prev")}
        c |= {f"no_{x}": np.array(batch.column(x).is_null().to_numpy(zero_copy_only=False)) for x in ("child", "prev")}
        ends, sizes, begin, n = flat(batch, ("ends", "sizes"))
        c |= {"begin": begin, "n": n, "done": np.zeros(len(n), np.int64)}
        ways = WAYS // 2
        while ways:
            can = np.flatnonzero(c["done"] + ways <= c["n"])
            where = c["begin"][can] + c["done"][can] + ways - 1
            order = np.argsort(ends[where], kind="stable")
            can, where = can[order], where[order]
            key = ends[where]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            many = np.diff(np.append(np.flatnonzero(new), len(key)))[np.cumsum(new) - 1] > 1
            stay, go, where = can[new & many], can[many], where[many]
            stays = {x: v[stay] for x, v in c.items()} | {"child": key[new & many], "no_child": np.zeros(len(stay), bool)}
            for x, v in (("key", ends[where]), ("size", sizes[where]), ("length", c["length"][go] + ways * step), ("done", c["done"][go] + ways)):
                c[x][go] = v
            c = {x: np.concatenate([v, stays[x]]) for x, v in c.items()}
            ways //= 2
        return c

    def run(batches):
        c = moved(batches)
        if c is None:
            return
        if not last:
            kinds = {x.split()[0]: pa.int32() if x.endswith(" int") else pa.int64() for x in _PLACE.split(", ")}
            yield pa.RecordBatch.from_arrays([pa.array(c[x], mask=c.get(f"no_{x}")).cast(kind) for x, kind in kinds.items()], list(kinds))
            return
        keys, first, of, records = np.unique(c["key"], return_index=True, return_inverse=True, return_counts=True)
        n, leaf = len(keys), c["no_child"]
        parent = np.full(n + 1, n)
        parent[np.searchsorted(keys, c["child"][~leaf])] = of[~leaf]
        depth, up = (parent < n).astype(np.int64), parent
        while (up < n).any():
            depth, up = depth + depth[up], up[up]
        least, most, alone = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, bool)
        named = leaf & ~c["no_prev"]
        np.minimum.at(least, of[named], c["prev"][named])
        np.maximum.at(most, of[named], c["prev"][named])
        alone[of[leaf & c["no_prev"]]] = True
        by_depth = np.argsort(depth[:n], kind="stable")
        starts = np.searchsorted(depth[by_depth], np.arange(depth[:n].max() + 2))
        for d in range(len(starts) - 2, 0, -1):
            x = by_depth[starts[d] : starts[d + 1]]
            np.minimum.at(least, parent[x], least[x])
            np.maximum.at(most, parent[x], most[x])
            np.logical_or.at(alone, parent[x], alone[x])
        maximal = np.append((records > 1) & (alone | (least != most)), True)
        above = np.where(maximal, np.arange(n + 1), parent)
        while (above != above[above]).any():
            above = above[above]
        place = np.flatnonzero(leaf)
        group = above[of[place]]
        while (group < n).any():
            place, group = place[group < n], group[group < n]
            for low in range(0, len(place), 100_000):
                x, g = place[low : low + 100_000], group[low : low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c["rid"][x], c["first"][x], c["size"][first[g]], keys[g])], ["rid", "first", "size", "key"])
            group = above[parent[group]]

    return run


def _maximal(runs: DataFrame) -> DataFrame:
    """(rid, first, size, key) of all instances of every maximal repeat of runs(rid, at, stop, sym, before), without those
    that hold a stretch that overlaps an equal one. key is a hash of the sequence.

    The places with one first stretch go to one task, by which the tree of their common beginnings is built: round by
    round, from long steps to short ones, places that share an end move on to it together. A place asks for a few ends a
    round, so what is written grows with the places, not with the sequences.
    """
    most, every = (x or 0 for x in runs.agg(F.max(F.size("sym")), F.sum(F.size("sym"))).first())
    tasks = min(LOTS, 8 + every // 8192)
    step, places = 1, None
    while step * WAYS < most:
        step *= WAYS
    while step:
        last = step == 1
        asked = _begun(runs, step, last)
        asked = asked if places is None else asked.unionByName(_carried(places, runs, step))
        found = asked.repartition(tasks, "root").mapInArrow(_descend(step, last), "rid long, first long, size long, key long" if last else _PLACE)
        places = found if last else cut(found)
        step //= WAYS
    return places


def maximal_groups(words: DataFrame, width: int, whole: bool = False) -> DataFrame:
    """(doc_id, first, last, of_doc, of_first, instances): all instances of every maximal repeat of `width` words or more.

    words(doc_id, w). A repeat is maximal if its instances, taken together, can be extended neither to the left nor to
    the right; a group is named by its smallest instance and has all of them, so groups overlap where a part of a copy
    stands in more places than the whole. Windows are combined to stretches first, and what sequences of stretches have
    in common is found as a tree, so that what is written grows with the text and the result, not with the number of
    sequences that repeat. Windows that overlap an equal one of their file are left out. A file's windows are ordered in
    one task, and so are the places with one first stretch. Files without tokens have none, and repeated rows of one
    doc_id count as one file with its words twice.

    whole: a group found so has as instances all places with its words whose first window isn't left out, also where a
    later one is, as text of a short period that begins before the instance makes its windows overlap equal ones. Their
    number is that of the sequences that hold such a window.
    """
    one = F.struct(*[F.col(c).cast("long").alias(c) for c in ("at", "stop")], "sym", F.coalesce("before", F.lit(-1)).cast("long").alias("before"))
    listed = _stretches(words, width, whole).groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(one)).alias("parts"))
    runs = cut(listed.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *[F.col(f"parts.{c}").alias(c) for c in ("at", "stop", "sym", "before")]))
    found = _maximal(runs).join(runs.select("rid", "doc_id"), "rid").select("doc_id", "first", "size", "key", F.lit(True).alias("plain"))
    if whole:
        found = found.unionByName(_overlapping(runs).withColumn("plain", F.lit(False)))
    found = cut(found)
    groups = found.groupBy("key", "size").agg(F.count(F.lit(1)).alias("instances"), F.min(F.struct("doc_id", "first")).alias("home"), F.bool_or("plain").alias("plain"))
    out = found.select("doc_id", "first", "size", "key").join(groups.filter("plain").drop("plain"), ["key", "size"])
    last = F.col("first") + F.col("size") + (width - 2)
    return out.select("doc_id", "first", last.alias("last"), F.col("home.doc_id").alias("of_doc"), F.col("home.first").alias("of_first"), "instances")


def long_enough(instances: DataFrame, token_lines: DataFrame, least: int = DEFAULTS["least_lines"]) -> DataFrame:
    """instances(doc_id, first, last, of_doc, of_first) with first_line and last_line, of groups whose home has `least` lines
    or more; token_lines(doc_id, pos, line) says where each token stands."""
    begin, end = (token_lines.select("doc_id", F.col("pos").alias(c), F.col("line").alias(f"{c}_line")) for c in ("first", "last"))
    placed = instances.join(begin, ["doc_id", "first"]).join(end, ["doc_id", "last"])
    home = placed.filter("doc_id = of_doc AND first = of_first AND last_line - first_line + 1 >= %d" % least)
    return placed.join(home.select("of_doc", "of_first", (F.col("last") - F.col("first")).alias("n")).distinct(), (placed["of_doc"] == home["of_doc"]) & (placed["of_first"] == home["of_first"]) & (placed["last"] - placed["first"] == F.col("n")), "left_semi")


def name_pattern(names: Column) -> Column:
    """The place of each name's first occurrence: equal for sequences that a one-to-one renaming maps on each other."""
    return F.transform(names, lambda x: F.array_position(names, x))


def one_to_one_windows(pairs: DataFrame, least: int) -> DataFrame:
    """(pair, first, length): the longest stretches of pairs(pair, pos, left, right) in which names map one-to-one.

    Positions of a pair follow on each other from 0. A pair's places are gathered in one row, for one_to_one_stretches.
    """
    places = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "left", "right")))
    rows = pairs.groupBy("pair").agg(places.alias("x"))
    return one_to_one_stretches(rows.select("pair", F.col("x.left").alias("left"), F.col("x.right").alias("right")), least)


def one_to_one_stretches(pairs: DataFrame, least: int) -> DataFrame:
    """(pair, first, length): the longest stretches of pairs(pair, left, right), arrays of names, that map one-to-one.

    A place conflicts with the last place before it that has one of its two names but not the other one. A stretch that
    ends at a place begins behind the last conflict so far, and is maximal where the next place moves that on. Places
    without a name on either side (null) conflict with nothing but count for the length; what one array has beyond the
    other counts for nothing. Stretches of fewer than `least` places are left out. A row is a pair of its own and needs no
    shuffle; rows are taken few at a time.
    """

    def slices(batch):
        ends = np.cumsum(np.array(batch.column("left").value_lengths().fill_null(0), np.int64))
        low = 0
        while low < batch.num_rows:
            upto = (ends[low - 1] if low else 0) + WORDS_AT_ONCE
            high = max(low + 1, int(np.searchsorted(ends, upto, side="right")))
            yield batch.slice(low, high - low)
            low = high

    def behind_conflict(row, pos, own, other):
        """For each place one more than the last conflict that its name of `own` makes, 0 without any."""
        at = np.flatnonzero((own >= 0) & (other >= 0))
        at = at[np.lexsort((pos[at], own[at], row[at]))]
        same = (row[at[1:]] == row[at[:-1]]) & (own[at[1:]] == own[at[:-1]])
        changed = np.zeros(len(at), np.int64)
        changed[1:] = np.where(same & (other[at[1:]] != other[at[:-1]]), pos[at[:-1]] + 1, 0)
        group = np.concatenate([[0], np.cumsum(~same)])[: len(at)] * (pos.max(initial=0) + 2)
        out = np.zeros(len(row), np.int64)
        out[at] = np.maximum.accumulate(changed + group) - group
        return out

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                n = np.array(batch.column("left").value_lengths(), np.int64)
                row = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                left, right = (np.array(batch.column(c).flatten().dictionary_encode().indices.fill_null(-1), np.int64) for c in ("left", "right"))
                step = row * (pos.max(initial=0) + 2)
                first = np.maximum.accumulate(np.maximum(behind_conflict(row, pos, left, right), behind_conflict(row, pos, right, left)) + step) - step
                ends = np.ones(len(row), bool)
                ends[:-1] = (row[1:] != row[:-1]) | (first[1:] != first[:-1])
                length = pos + 1 - first
                kept = np.flatnonzero(ends & (length >= least))
                yield pa.RecordBatch.from_arrays([batch.column("pair").take(pa.array(row[kept])), pa.array(first[kept]), pa.array(length[kept])], ["pair", "first", "length"])

    both = F.least(*[F.coalesce(F.size(c), F.lit(0)) for c in ("left", "right")])
    cut_off = [F.slice(c, F.lit(1), both).alias(c) for c in ("left", "right")]
    rows = pairs.filter(both >= max(least, 1)).select("pair", *cut_off)
    return rows.mapInArrow(run, f"pair {pairs.schema['pair'].dataType.simpleString()}, first long, length long")


def line_and_column(text: Column, offset: Column) -> Column:
    """(line, column) of a character offset, lines from 1 and columns from 0."""
    before = F.substr(text, F.lit(1), offset)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.cast("long").alias("line"), F.length(F.substring_index(before, "\n", -1)).cast("long").alias("column"))


def without_contained(spans: DataFrame) -> DataFrame:
    """spans(doc_id, first, last) that lie in no other span of their document."""
    s = spans.select("doc_id", "first", "last").distinct()
    w = Window.partitionBy("doc_id").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("reach", F.max("last").over(w)).filter("reach IS NULL OR reach < last").drop("reach")


def without_ignored(spans: DataFrame, ignored: DataFrame, width: int = 64) -> DataFrame:
    """spans(doc_id, first, last) that no range of ignored(doc_id, start, stop) touches, by bins of lines."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    s = spans.select("doc_id", "first", "last").distinct().withColumn("bin", cells("first", "last"))
    hit = s.join(ignored.withColumn("bin", cells("start", "stop")), ["doc_id", "bin"]).filter("first <= stop AND start <= last")
    return spans.join(hit.select("doc_id", "first", "last").distinct(), ["doc_id", "first", "last"], "left_anti")


def dead_clones(spans: DataFrame, unused_files: DataFrame, unused_exports: DataFrame) -> DataFrame:
    """(doc_id, first, last, reason): spans in unused_files(doc_id), else with a line of unused_exports(doc_id, line, name).

    All three are ordered together by file, from its last line back, so a span's reason is the nearest export that came
    before it and doesn't lie behind it; spans of one file with equal lines count once, but for those of an unused file.
    """
    row = lambda df, kind, first, last, name: df.select("doc_id", F.lit(kind).alias("kind"), F.expr(first).cast("long").alias("first"), F.expr(last).cast("long").alias("last"), F.expr(name).cast("string").alias("name"))
    every = row(unused_files, 0, "null", "null", "null").unionByName(row(unused_exports.filter("line IS NOT NULL"), 1, "line", "line", "name")).unionByName(row(spans, 2, "first", "last", "null"))
    so_far = Window.partitionBy("doc_id").orderBy(F.desc_nulls_first("first"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.min(F.when(F.col("kind") == 1, F.struct(F.col("first").alias("line"), "name"))).over(so_far)
    seen = lots(every.filter("doc_id IS NOT NULL"), "doc_id").withColumns({"dead": F.bool_or(F.col("kind") == 0).over(so_far), "export": nearest}).filter("kind = 2")
    found = seen.filter("dead OR (first IS NOT NULL AND export.line <= last)").groupBy("doc_id", "first", "last", F.expr("if(dead, 'file', export.name)").alias("reason"), "dead")
    return found.agg(F.count(F.lit(1)).alias("n")).select("doc_id", "first", "last", "reason", F.explode(F.expr("array_repeat(0, if(dead, int(n), 1))"))).drop("col")
