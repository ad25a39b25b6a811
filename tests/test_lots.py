"""Operators that deal their rows out in lots, against plain ones on odd rows; each input is dealt out once."""

import random
import re
from collections import Counter

import pytest

from tessera.functions import lots as dealing
from tessera.operators import clones, detectors, findings, graphs, metrics
from tessera.plans import QUERIES


@pytest.fixture(params=[1, 7])
def few(request, monkeypatch):
    monkeypatch.setattr(dealing, "LOTS", request.param)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    return [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]


def maybe(rng, *values):
    return rng.choice([None, *values * 4])


def test_ownership_sorts_once(spark, few):
    rng = random.Random(1)
    rows = [(rng.choice("pqr"), rng.randint(0, 6)) for _ in range(200)]
    df = metrics.ownership(spark.createDataFrame(rows, "path string, author int"), "path", "author")
    got = {r["path"]: (r["top"], r["share"], r["authors"], r["bus_factor"]) for r in df.collect()}
    for path in "pqr":
        n = Counter(a for p, a in rows if p == path)
        order, total = sorted(n, key=lambda a: (-n[a], a)), sum(n.values())
        before = [sum(n[b] for b in order[:i]) for i in range(len(order))]
        assert got[path] == (order[0], round(n[order[0]] / total, 4), len(n), sum(2 * b < total for b in before))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(exchanges(df)) == 1 and sum(" Sort [" in line for line in plan.split("== Initial")[0].split("\n")) == 1


def test_moved_with_nulls(spark, few):
    rng = random.Random(3)
    rows = lambda n: [(maybe(rng, 1, 2), maybe(rng, "x"), maybe(rng, *"abcdefgh")) for _ in range(n)]
    base, head = rows(60), rows(60)
    gone = {r for r in base if r not in head or None in r}
    new = {r for r in head if r not in base or None in r}
    side = lambda found, k: sorted((r[2] for r in found if r[:2] == k), key=lambda p: (p is not None, p or ""))
    expected = sorted((str(k), str(a), str(b)) for k in {r[:2] for r in base} if None not in k for a, b in zip(side(gone, k), side(new, k)))
    frame = lambda r: spark.createDataFrame(r, "part int, rule string, path string")
    df = findings.moved(frame(base), frame(head), ["part", "rule"])
    assert sorted((str((r["part"], r["rule"])), str(r["base_path"]), str(r["head_path"])) for r in df.collect()) == expected and expected
    assert df.columns == ["part", "rule", "base_path", "head_path"] and len(exchanges(df)) == 1


def test_lines_in_a_diff_with_nulls(spark, few):
    rng = random.Random(4)
    ranges = [(maybe(rng, 1, 2, 3), maybe(rng, a := rng.randint(0, 300)), maybe(rng, a + rng.randint(-20, 60))) for _ in range(15)] + [(9, None, None)]
    rows = [(i, maybe(rng, 1, 2, 3, 4, 9), maybe(rng, rng.randint(0, 380))) for i in range(300)]
    rows += rows[:40]
    hit = lambda p, x: p is None or any(p == q and (x is None or (None not in (a, b) and a <= x <= b)) for q, a, b in ranges)
    df = findings.in_diff(spark.createDataFrame(rows, "id int, path int, line long"), spark.createDataFrame(ranges, "path int, first long, last long"))
    expected = Counter(r for r in rows if hit(*r[1:]))
    assert Counter(map(tuple, df.collect())) == expected and df.columns == ["id", "path", "line"] and 50 < len(expected) < 290
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_dead_clones_with_nulls(spark, few):
    rng = random.Random(5)
    spans = [(maybe(rng, 1, 2, 3, 4), maybe(rng, a := rng.randint(0, 300)), maybe(rng, a + rng.randint(-3, 90))) for _ in range(150)]
    spans += spans[:30]
    exports = [(maybe(rng, 1, 2, 3, 4), maybe(rng, rng.randint(0, 350)), rng.choice("abcd")) for _ in range(25)]
    files, expected, once = [1, None], Counter(), set()
    for d, a, b in spans:
        near = sorted((line, n) for f, line, n in exports if f == d and None not in (d, line, a, b) and a <= line <= b)
        if d == 1:
            expected[d, a, b, "file"] += 1
        elif near:
            once.add((d, a, b, near[0][1]))
    frame = spark.createDataFrame
    df = clones.dead_clones(frame(spans, "doc_id int, first long, last long"), frame([(f,) for f in files], "doc_id int"), frame(exports, "doc_id int, line long, name string"))
    assert Counter(map(tuple, df.collect())) == expected + Counter(once) and len(once) > 20 and df.columns == ["doc_id", "first", "last", "reason"]
    assert len(exchanges(df)) == 1


def test_boundaries_with_nulls_and_repeats(spark):
    rng = random.Random(6)
    edges = [(rng.choice("abcde"), rng.choice("vwxyz"), maybe(rng, 1, 2, 3), maybe(rng, True, False)) for _ in range(150)]
    zone = {"a": 0, "b": 1, "c": 0, "d": 2, "v": 1, "w": 0, "x": 2, "y": 1}
    allowed = [(0, 1, True), (1, 2, True), (1, 2, False), (2, 0, True)]
    public, hidden = ["w", "w"], [("a", 1), ("a", 1), ("b", 2), ("d", None), ("d", 1), (None, 1)]
    passes = {(0, 1): True, (1, 2): False, (2, 0): True}
    expected = set()
    for s, d, line, types in edges:
        za, zb = zone.get(s), zone.get(d)
        if None in (za, zb) or za == zb or d in public or (s, None) in hidden or (line is not None and (s, line) in hidden):
            continue
        if (za, zb) in passes and (not passes[za, zb] or types):
            continue
        expected.add((s, d, line, za, zb))
    frame = spark.createDataFrame
    df = detectors.boundary_findings(
        frame(edges, "src string, dst string, line int, type_only boolean"), frame(list(zone.items()), "node string, zone int"), frame(allowed, "zone_a int, zone_b int, type_only boolean"),
        frame([(p,) for p in public], "node string"), frame(hidden, "src string, line int"),
    )
    rows = df.collect()
    assert len(rows) == len(expected) > 8 and {tuple(r) for r in rows} == expected


def test_imports_are_dealt_out_twice(spark, sf_dir):
    """Joins of the imports themselves: one by each end, behind the one with orders."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["boundary_findings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(src#" in plan and not re.search(r"hashpartitioning\(src#\d+, \w+#", plan)


def test_frames_in_many_lots(spark, few):
    frames = [(i, i % 3, f"at f (/app/src/{x}.ts:{i}:7)") for i, x in enumerate("abcabcz")] + [(1, 1, "no place"), (None, 0, "at (/app/src/a.ts:4:1)")]
    df = graphs.stack_frames(spark.createDataFrame(frames, "trace int, pos int, frame string"), spark.createDataFrame([("src/a.ts",), ("a.ts",), ("b.ts",)], "path string"))
    got = {(r["trace"], r["pos"]): (r["path"], r["line"]) for r in df.collect() if r["trace"] not in (1, None)}
    assert got == {(0, 0): ("src/a.ts", 0), (2, 2): (None, None), (3, 0): ("src/a.ts", 3), (4, 1): ("b.ts", 4), (5, 2): (None, None), (6, 0): (None, None)} and df.count() == 9
