"""Cycles that are accepted, capped or can't be told, and components of hard shapes, against plain listings."""

import random

import pytest

from tessera.operators import graphs


def cycles_of(edges, longest):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()

    def walk(path):
        for x in out.get(path[-1], ()):
            if x == path[0] and len(path) > 1:
                found.add(tuple(path))
            if x > path[0] and x not in path and len(path) < longest:
                walk([*path, x])

    for a in list(out):
        walk([a])
    return found


def components_of(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    while True:
        grown = {n: reach[n] | {b for a, b in edges if a in reach[n]} for n in nodes}
        if grown == reach:
            break
        reach = grown
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if any(m != n and m in reach[n] and n in reach[m] for m in nodes)}


def table(spark, edges):
    return spark.createDataFrame(sorted(edges), "src long, dst long")


RANDOM = [{(r.randrange(n), r.randrange(n)) for _ in range(m)} for r, n, m in [(random.Random(1), 12, 26), (random.Random(2), 25, 40)]]
CHAIN = {(i, i + 1) for i in range(30)} | {(30, 0), (50, 51), (51, 50), (30, 50), (60, 61), (61, 62)}


@pytest.mark.parametrize("edges", [*RANDOM, CHAIN])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in graphs.strong_components(table(spark, edges)).collect()}
    assert got == components_of(edges)


@pytest.mark.parametrize("cap", [None, 1, 3])
def test_entries(spark, cap):
    """A component with many cycles, one with few; entries told from other nodes on, too long ones and ones across components."""
    edges = {(a, b) for a in range(5) for b in range(5) if a != b} | {(10, 11), (11, 12), (12, 10), (5, 10)}
    entries = [(1, [1, 0]), (2, [0, 1]), (3, [12, 10, 11]), (4, [10, 12, 11]), (5, [0, 2, 1]), (6, [0, 1, 2, 3, 4]), (7, [0, 10]), (8, [3, 99]), (9, [4])]
    frame = spark.createDataFrame(entries, "entry long, files array<long>")
    cycles = graphs.Cycles(table(spark, edges), 4, cap=cap, entries=frame)
    every = cycles_of(edges, 4)
    accepted = {tuple(f[f.index(min(f)) :] + f[: f.index(min(f))]) for _, f in entries}
    left = sorted((len(c), ">".join(map(str, c))) for c in every - accepted)
    got = sorted((r["hops"], r["cycle"]) for r in cycles.found.collect())
    assert got == (left if cap is None else left[:cap])
    state = {r["entry"]: r["state"] for r in cycles.entry_states().collect()}
    assert state[1] == state[2] == state[3] == "matched" and state[6] == "unprovable" and state[4] == state[7] == state[8] == "unmatched"
    assert state[5] == ("matched" if cap is None else "unprovable") and state[9] == ("unmatched" if cap is None else "unprovable")
    if cap:
        assert [r["component"] for r in cycles.capped.collect()] == [0]
