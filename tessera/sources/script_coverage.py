"""Counts of a JavaScript engine's coverage dumps on statements and functions, through the source maps of what it ran."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.resolution import folder, normalise

DUMP = """result array<struct<url string, functions array<struct<ranges array<struct<startOffset bigint, endOffset bigint, count bigint>>>>>>,
  `source-map-cache` map<string, struct<url string, lineLengths array<bigint>, data struct<sourceRoot string, sources array<string>, sourcesContent array<string>, mappings string>>>"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
#: fixed values: the digits of a map's numbers in order, and the names of a virtual source that are no folder
DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
NO_FOLDER = ("", ".", "_N_E")
#: fixed value: scripts are dealt to so many lots, whose scripts go to Python together
LOTS = 4096

VALUES = np.full(256, -1, dtype=np.int64)
VALUES[np.frombuffer(DIGITS, dtype=np.uint8)] = np.arange(64)


def unescaped(path: Column) -> Column:
    """A path with its %XX read as UTF-8; as it is where that can't be read."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def local_path(url: Column) -> Column:
    """The path of a file URL, or of an absolute path; null for every other URL and for a relative path."""
    rest = F.regexp_replace(url, r"^(?i)file://(localhost)?(?=/)", "")
    return F.when(url.rlike(r"^(?i)file:///|^(?i)file://localhost/"), unescaped(rest)).when(url.rlike(r"^/|^[A-Za-z]:[\\/]"), url)


def scripts(dumps: DataFrame) -> DataFrame:
    """(dump, script, url, ranges, map) of dumps(dump, value): each script of a dump with its ranges in order, and what
    the dump's cache has for its URL. A dump that is no JSON or has no result gives nothing; of equal names one counts."""
    read = dumps.dropDuplicates(["dump"]).select("dump", F.from_json("value", DUMP).alias("d"))
    each = read.select("dump", F.col("d.source-map-cache").alias("maps"), F.posexplode("d.result").alias("script", "s"))
    none = F.array().cast("array<struct<startOffset bigint, endOffset bigint, count bigint>>")
    ranges = F.coalesce(F.flatten(F.transform(F.filter("s.functions", lambda f: f["ranges"].isNotNull()), lambda f: f["ranges"])), none)
    return each.filter("s.url IS NOT NULL").select("dump", "script", "s.url", ranges.alias("ranges"), F.try_element_at("maps", F.col("s.url")).alias("map"))


def generated_length(lengths: Column) -> Column:
    """Units of a text of lines of these lengths: one more for each break."""
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x) + F.size(lengths) - 1


def script_sources(found: DataFrame, files: DataFrame) -> DataFrame:
    """(dump, script, source, path): which of files(path, content) the sources of scripts are, source null where a script
    without a map is the file itself.

    A map counts only if the ranges end where its line lengths say. A relative source starts from the folder of the map,
    or of the script where the map has no URL. A webpack or vite source is the first file below that folder or the nearest
    above it, with its namespace first and as it is escaped last. A source whose text in the map isn't that of the file,
    byte order marks aside, is left out; a null content or text can't be told and counts. Paths meet normalised.
    """
    known = files.filter("path IS NOT NULL").dropDuplicates(["path"]).select("path", "content", normalise(F.col("path")).alias("at"))
    plain = found.filter("map IS NULL").select("dump", "script", F.lit(None).cast("int").alias("source"), normalise(local_path(F.col("url"))).alias("at"))
    ends = F.coalesce(F.array_max(F.transform("ranges", lambda r: r["endOffset"])), F.lit(0))
    mapped = found.filter(F.col("map.data.mappings").isNotNull() & (ends == generated_length(F.col("map.lineLengths"))))
    here, there = folder(local_path(F.col("url"))), F.col("map.url")
    base = F.when(F.coalesce(there, F.lit("")) == "", here).when(local_path(there).isNotNull(), folder(local_path(there)))
    base = base.when(there.rlike(SCHEME), None).otherwise(folder(F.concat_ws("/", here, there)))
    base = F.when(here.isNotNull(), base)
    each = mapped.select("dump", "script", base.alias("base"), F.col("map.data.sourceRoot").alias("root"), F.col("map.data.sourcesContent").alias("texts"), F.posexplode("map.data.sources").alias("source", "name"))
    rooted = (F.coalesce("root", F.lit("")) != "") & ~F.col("name").rlike(SCHEME) & ~F.startswith("name", F.lit("/"))
    each = each.withColumn("name", F.when(rooted, F.concat_ws("/", F.regexp_replace("root", "/$", ""), "name")).otherwise(F.col("name")))
    virtual = F.regexp_extract("name", r"^(?i)(webpack|vite)://([^/]*)(/[^?#]*)?", 0) != ""
    space, raw = (F.regexp_extract("name", r"^[A-Za-z]+://([^/]*)(/[^?#]*)?", i) for i in (1, 2))
    read = F.when(F.exists(F.split(raw, "/"), lambda p: unescaped(p).rlike(r"[/\\]")), raw).otherwise(unescaped(raw))
    names = F.array_distinct(F.flatten(F.transform(F.array(read, raw), lambda p: F.when(space.isin(*NO_FOLDER), F.array(p)).otherwise(F.array(F.concat(space, p), p)))))
    parts = F.split(normalise(F.col("base")), "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    single = F.coalesce(local_path(F.col("name")), F.when(~F.col("name").rlike(SCHEME) & F.col("base").isNotNull(), F.concat_ws("/", "base", "name")))
    ways = F.when(virtual & F.col("base").isNotNull(), F.flatten(F.transform(above, lambda b: F.transform(names, lambda n: F.concat_ws("/", b, n))))).when(~virtual & single.isNotNull(), F.array(single))
    text = F.try_element_at("texts", F.col("source") + 1)
    tried = each.filter("name <> ''").select("dump", "script", "source", text.alias("text"), F.posexplode(ways).alias("rank", "way"))
    hit = tried.withColumn("at", normalise(F.col("way"))).join(known, "at")
    first = hit.groupBy("dump", "script", "source").agg(F.min_by(F.struct("path", "content", "text"), F.struct("rank", "path")).alias("f"))
    bare = lambda c: F.regexp_replace(c, "^\ufeff", "")
    same = F.coalesce(bare("f.text") == bare("f.content"), F.lit(True))
    return first.filter(same).select("dump", "script", "source", "f.path").unionByName(plain.join(known, "at").select("dump", "script", "source", "path"))


def decode(mappings: str) -> tuple[np.ndarray, ...]:
    """Generated line and column, source, original line and column of each segment that has a source, in order."""
    raw = np.frombuffer(mappings.encode("ascii", "replace"), dtype=np.uint8)
    value = VALUES[raw]
    at = np.flatnonzero(value >= 0)
    ends = np.flatnonzero((value[at] & 32) == 0)
    if not len(ends):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    at = at[: ends[-1] + 1]
    begins = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(at)) - np.repeat(begins, ends - begins + 1)
    number = np.add.reduceat((value[at] & 31) << np.minimum(5 * place, 55), begins)
    number = np.where(number & 1, -(number >> 1), number >> 1)
    segment = np.cumsum((raw == 44) | (raw == 59))[at[begins]]
    line = np.cumsum(raw == 59)[at[begins]]
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    size = np.diff(np.r_[first, len(number)])
    row = line[first]
    column = np.cumsum(number[first])
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    column = column - np.repeat(np.r_[0, column[start[1:] - 1]], np.diff(np.r_[start, len(row)]))
    full = size >= 4
    sums = [np.cumsum(number[first[full] + k]) for k in (1, 2, 3)]
    return row[full], column[full], sums[0], sums[1], sums[2]


def innermost(ranges: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The count of the smallest of ranges(start, end, count) around each offset, the first of equal ones; 0 in none."""
    if not len(ranges):
        return np.zeros(len(offsets), dtype=np.int64)
    start, end, count = ranges.T
    edges = np.unique(np.r_[start, end])
    cells = np.zeros(len(edges), dtype=np.int64)
    back = np.arange(len(ranges))[::-1]
    for i in back[np.argsort((start - end)[back], kind="stable")]:
        cells[np.searchsorted(edges, start[i]) : np.searchsorted(edges, end[i])] = count[i]
    cell = np.searchsorted(edges, offsets, side="right") - 1
    return np.where(cell >= 0, cells[np.maximum(cell, 0)], 0)


def generated_offsets(segments: tuple[np.ndarray, ...], lengths: np.ndarray, line: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Offsets of original places (line from 0) by one source's segments: the last one of the line up to there, else the
    first one after it; the first of those right there; -1 without any."""
    row, col, _, was, at = segments
    order = np.lexsort((col, row, at, was))
    key = (was[order] << 32) | at[order]
    asked = (line << 32) | column
    left = np.searchsorted(key, asked)
    padded = np.r_[key, -1]
    exact, before, after = padded[left] == asked, (left > 0) & (padded[left - 1] >> 32 == line), padded[left] >> 32 == line
    pick = np.where(exact, left, np.where(before, left - 1, left))
    found = exact | before | after
    starts = np.r_[0, np.cumsum(lengths + 1)]
    mapped = np.r_[row[order], 0][np.where(found, pick, 0)], np.r_[col[order], 0][np.where(found, pick, 0)]
    found &= mapped[0] < len(lengths)
    return np.where(found, starts[np.where(found, mapped[0], 0)] + mapped[1], -1)


COUNTS = "path string, kind string, id string, count bigint"
ROWS = pa.schema([("path", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("count", pa.int64())])


def _counted_lot(key: tuple, ran: pa.Table, spots: pa.Table) -> pa.Table:
    """Counts of the statements and functions of the sources of a lot's scripts, each script worked on alone."""
    if not ran.num_rows or not spots.num_rows:
        return ROWS.empty_table()
    names = pc.unique(ran.column("ran_dump"))
    code = lambda dump, script: (pc.index_in(dump, value_set=names).to_numpy().astype(np.int64) << 32) | script.to_numpy().astype(np.int64)
    own, of = code(ran.column("ran_dump"), ran.column("ran_script")), code(spots.column("dump"), spots.column("script"))
    col = {c: pc.fill_null(pc.cast(spots.column(c), pa.int64()), -1).to_numpy() for c in ("source", "line", "column", "end_line", "end_column", "offset")}
    order = np.lexsort((col["column"], col["line"], col["source"], of))
    col, of = {c: x[order] for c, x in col.items()}, of[order]
    col["function"] = pc.equal(spots.column("kind"), "function").to_numpy()[order]
    low, high = np.searchsorted(of, own), np.searchsorted(of, own, side="right")
    lists = {c: ran.column(c).combine_chunks() for c in ("starts", "ends", "counts", "lengths")}
    bounds = {c: np.r_[0, np.cumsum(x.value_lengths().fill_null(0).to_numpy())] for c, x in lists.items()}
    values = {c: x.flatten().fill_null(0).to_numpy() for c, x in lists.items()}
    mappings = ran.column("mappings")
    counts, sure = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=bool)
    for i in np.flatnonzero(high > low):
        one = {c: x[bounds[c][i] : bounds[c][i + 1]] for c, x in values.items()}
        part = slice(low[i], high[i])
        counts[part], sure[part] = _counted(np.column_stack([one[c] for c in ("starts", "ends", "counts")]), mappings[int(i)].as_py(), one["lengths"], {c: x[part] for c, x in col.items()})
    kept = order[sure]
    columns = [spots.column(c).take(pa.array(kept)) for c in ("path", "kind", "id")]
    return pa.Table.from_arrays([*columns, pa.array(counts[sure])], schema=ROWS)


def _counted(ranges: np.ndarray, mappings: str | None, lengths: np.ndarray, col: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the spots of one script's sources, in order of source, line and column, and which of these have one."""
    function = col["function"]
    place, until = (col["line"] << 32) | col["column"], (col["end_line"] << 32) | np.maximum(col["end_column"], 0)
    segments = None if mappings is None else decode(mappings)
    counts, sure = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=bool)
    bounds = np.flatnonzero(np.r_[True, col["source"][1:] != col["source"][:-1], True])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = slice(lo, hi)
        if segments is None:
            offsets = col["offset"][part]
        else:
            mine = segments[2] == col["source"][lo]
            offsets = generated_offsets(tuple(x[mine] for x in segments), lengths, col["line"][part] - 1, col["column"][part])
        n, told, of = innermost(ranges, offsets), offsets >= 0, function[part]
        known = told & ~of
        inside = np.searchsorted(place[part][known], place[part])
        held = np.r_[place[part][known], np.iinfo(np.int64).max][inside] < until[part]
        counts[part] = np.where(of & ~told, np.where(held, np.r_[n[known], 0][inside], 0), n)
        sure[part] = told | of
    return counts, sure


def script_counts(dumps: DataFrame, files: DataFrame, spots: DataFrame) -> DataFrame:
    """(path, kind, id, count): how often each statement and function of spots ran in all dumps(dump, value).

    files(path, content) are the sources that can be met (see script_sources), spots(path, kind, id, line, column,
    end_line, end_column, offset) what they hold: kind 'statement' or 'function', lines from 1, columns and offsets in
    UTF-16 units from 0; the end is asked of functions, the offset of files that run as they are. A spot's count is that
    of the smallest range around it. A statement that no script maps has no row; a function without a place of its own
    takes the count of the first mapped statement inside, or 0. Counts of scripts and dumps add up. Spots without line,
    column, kind or id have no row, and repeated ones count once.

    Each script with its map, which is one cell of its dump, is worked on alone; spots come as rows of its sources. Scripts
    go to Python in lots, each with about a 4,096th of all.
    """
    found = scripts(dumps)
    told = spots.dropna(subset=["path", "kind", "id", "line", "column"]).dropDuplicates(["path", "kind", "id"])
    asked = script_sources(found, files).join(told, "path")
    asked = asked.select("dump", "script", "path", "source", "kind", F.col("id").cast("string").alias("id"), "line", "column", "end_line", "end_column", "offset")
    bounds = [F.expr(f"transform(ranges, r -> coalesce(r.{c}, 0L))").alias(n) for c, n in (("startOffset", "starts"), ("endOffset", "ends"), ("count", "counts"))]
    ran = found.select(F.col("dump").alias("ran_dump"), F.col("script").alias("ran_script"), *bounds, F.col("map.data.mappings").alias("mappings"), F.col("map.lineLengths").alias("lengths"))
    lot = lambda df, *of: df.withColumn("lot", F.pmod(F.xxhash64(*of), F.lit(LOTS))).groupBy("lot")
    each = lot(ran, "ran_dump", "ran_script").cogroup(lot(asked, "dump", "script")).applyInArrow(_counted_lot, COUNTS)
    return each.groupBy("path", "kind", "id").agg(F.sum("count").alias("count"))


def measured(counts: DataFrame) -> DataFrame:
    """(path, statements, covered) of script_counts, the form of other coverage reports."""
    return counts.filter("kind = 'statement'").groupBy("path").agg(F.count(F.lit(1)).alias("statements"), F.count_if(F.col("count") > 0).alias("covered"))
