"""Counts through source maps: decoding against a plain reader, places and ranges by brute force, sources by hand."""

import json
import random

import numpy as np
import pytest

from tessera.sources import script_coverage as sc


def vlq(n):
    n, out = (-n << 1 | 1) if n < 0 else n << 1, ""
    while True:
        out += chr(sc.DIGITS[n & 31 | (32 if n > 31 else 0)])
        n >>= 5
        if not n:
            return out


def encode(lines):
    """Mappings of lines of segments (column,) or (column, source, line, column)."""
    last, rows = [0, 0, 0], []
    for line in lines:
        at, parts = 0, []
        for s in line:
            parts.append(vlq(s[0] - at) + "".join(vlq(x - y) for x, y in zip(s[1:], last)))
            at, last = s[0], list(s[1:]) or last
        rows.append(",".join(parts))
    return ";".join(rows)


@pytest.mark.parametrize("seed", range(4))
def test_decode(seed):
    r = random.Random(seed)
    lines = [[(c,) if r.random() < 0.2 else (c, r.randrange(5), r.randrange(90), r.randrange(4000)) for c in sorted(r.sample(range(9000), r.randrange(5)))] for _ in range(40)]
    expected = [(n, *s) for n, line in enumerate(lines) for s in line if len(s) > 1]
    assert [tuple(int(x) for x in t) for t in zip(*sc.decode(encode(lines)))] == expected


def test_decode_of_odd_texts():
    assert all(len(x) == 0 for text in ("", ";;;", "g", ",", "ä", "A") for x in sc.decode(text))
    assert [x.tolist() for x in sc.decode("AAAA;AACAg")] == [[0, 1], [0, 0], [0, 0], [0, 1], [0, 0]]


@pytest.mark.parametrize("seed", range(3))
def test_innermost(seed):
    r = random.Random(seed)
    ranges = [(a, a + r.choice([0, 1, 5, 20]), r.randrange(9)) for a in (r.randrange(60) for _ in range(30))]
    near = lambda o: min(((e - s, i) for i, (s, e, _) in enumerate(ranges) if s <= o < e), default=None)
    expected = [ranges[near(o)[1]][2] if near(o) else 0 for o in range(90)]
    assert sc.innermost(np.array(ranges), np.arange(90)).tolist() == expected
    assert sc.innermost(np.zeros((0, 3), dtype=np.int64), np.arange(2)).tolist() == [0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_generated_offsets(seed):
    r = random.Random(seed)
    segments = sorted((r.randrange(12), r.randrange(30), 0, r.randrange(6), r.randrange(10)) for _ in range(25))
    lengths = [40] * 11
    asked = [(line, c) for line in range(7) for c in range(12)]
    expected = []
    for line, c in asked:
        same = sorted((s[4], s[0], s[1]) for s in segments if s[3] == line)
        exact, before, after = [x for x in same if x[0] == c], [x for x in same if x[0] < c], [x for x in same if x[0] > c]
        hit = exact[0] if exact else before[-1] if before else after[0] if after else None
        expected.append(-1 if hit is None or hit[1] >= 11 else hit[1] * 41 + hit[2])
    arrays = tuple(np.array(x, dtype=np.int64) for x in zip(*segments))
    line, column = np.array(asked, dtype=np.int64).T
    assert sc.generated_offsets(arrays, np.array(lengths), line, column).tolist() == expected


SPOTS = "path string, kind string, id int, line int, column int, end_line int, end_column int, offset long"
FILES = "path string, content string"


def dump(*results, **maps):
    return json.dumps({"result": [{"scriptId": "1", "url": u, "functions": [{"functionName": "", "ranges": [dict(zip(("startOffset", "endOffset", "count"), r)) for r in rs]}]} for u, rs in results], "source-map-cache": maps.get("maps", {})})


def entry(mappings, lengths, sources, url=None, contents=None, root=None):
    return {"url": url, "lineLengths": lengths, "data": {"version": 3, "sources": sources, "sourcesContent": contents, "sourceRoot": root, "mappings": mappings}}


def counts(spark, dumps, files, spots):
    frame = sc.script_counts(spark.createDataFrame(dumps, "dump string, value string"), spark.createDataFrame(files, FILES), spark.createDataFrame(spots, SPOTS))
    return {(r.path, r.kind, r.id): r["count"] for r in frame.collect()}


def test_counts(spark):
    """A mapped script run in two dumps, a plain one, a stale map and a dump that is none."""
    text = encode([[(0, 0, 0, 0), (8, 0, 1, 2)], [], [(4, 0, 4, 0)]])
    one = dump(("file:///p/dist/b.js", [(0, 31, 1), (8, 20, 0)]), ("file:///p/run.js", [(0, 10, 2), (3, 5, 7)]), ("node:fs", [(0, 5, 1)]), maps={"file:///p/dist/b.js": entry(text, [10, 10, 9], ["../src/a.ts"])})
    two = dump(("file:///p/dist/b.js", [(0, 31, 3)]), maps={"file:///p/dist/b.js": entry(text, [10, 10, 9], ["../src/a.ts"])})
    stale = dump(("file:///p/dist/b.js", [(0, 99, 50)]), maps={"file:///p/dist/b.js": entry(text, [10, 10, 9], ["../src/a.ts"])})
    a, run = "/p/src/a.ts", "/p/run.js"
    spots = [
        (a, "statement", 0, 1, 0, None, None, None), (a, "statement", 1, 2, 2, None, None, None), (a, "statement", 2, 5, 7, None, None, None), (a, "statement", 3, 9, 0, None, None, None),
        (a, "function", 0, 2, 0, 3, 0, None), (a, "function", 1, 4, 0, 6, 0, None), (a, "function", 2, 8, 0, 9, 9, None), (a, "statement", None, 1, 0, None, None, None), (a, "statement", 4, None, 0, None, None, None),
        (run, "statement", 0, 1, 4, None, None, 4), (run, "statement", 1, 1, 5, None, None, 5), (run, "statement", 2, 1, 6, None, None, None), ("/p/other.ts", "statement", 0, 1, 0, None, None, 0),
    ]
    got = counts(spark, [("1", one), ("2", two), ("2", two), ("3", stale), ("4", "no {"), ("5", None), ("6", "{}")], [(a, None), (run, "x"), (None, None), (a, None)], spots + spots[:2])
    assert got == {
        (a, "statement", "0"): 4, (a, "statement", "1"): 3, (a, "statement", "2"): 4, (a, "function", "0"): 3, (a, "function", "1"): 4, (a, "function", "2"): 0,
        (run, "statement", "0"): 7, (run, "statement", "1"): 2,
    }


def test_sources(spark):
    """Where sources lie: by the map's folder, a root, URLs, virtual names above the script, texts that differ."""
    text, names = encode([[(0, n, 0, 0) for n in range(1)]]), {}
    cases = {
        "rel": ("../src/a.ts", None), "map": ("a.ts", "../src/x.map"), "abs": ("/p/src/a.ts", None), "url": ("file:///p/src/a%20b.ts", None), "pack": ("webpack://app/./src/a.ts", None),
        "space": ("webpack://app/deep.ts", None), "none": ("webpack://app/gone.ts", None), "far": ("https://x/a.ts", None), "remote": ("a.ts", "https://x/y.map"), "empty": ("", None),
        "vite": ("vite:///src/a%20b.ts", None), "next": ("webpack://_N_E/./src/a.ts?abcd", None), "absmap": ("a.ts", "/p/src/x.map"),
    }
    files = [("/p/src/a.ts", "text"), ("/p/src/a b.ts", None), ("/p/app/deep.ts", None), ("/p/deep.ts", None), ("/deep.ts", None)]
    maps = {f"file:///p/dist/{n}.js": entry(text, [5], [s], url) for n, (s, url) in cases.items()}
    maps["file:///p/dist/root.js"] = entry(text, [5], ["a.ts"], root="../src/")
    maps["file:///p/dist/same.js"] = entry(text, [5], ["../src/a.ts"], contents=["\ufefftext"])
    maps["file:///p/dist/old.js"] = entry(text, [5], ["../src/a.ts"], contents=["older"])
    value = dump(*[(u, [(0, 5, 1)]) for u in maps], maps=maps)
    found = sc.scripts(spark.createDataFrame([("d", value)], "dump string, value string"))
    got = {r.url.split("/")[-1][:-3]: r.path for r in sc.script_sources(found, spark.createDataFrame(files, FILES)).join(found.select("script", "url"), "script").collect()}
    a = "/p/src/a.ts"
    assert got == {"rel": a, "map": a, "abs": a, "url": "/p/src/a b.ts", "pack": a, "space": "/p/app/deep.ts", "vite": "/p/src/a b.ts", "next": a, "absmap": a, "root": a, "same": a}


def test_measured_and_empty(spark):
    frame = spark.createDataFrame([("a", "statement", "1", 0), ("a", "statement", "2", 5), ("a", "function", "1", 5)], sc.COUNTS)
    assert [tuple(r) for r in sc.measured(frame).collect()] == [("a", 2, 1)]
    assert counts(spark, [], [], []) == {}
