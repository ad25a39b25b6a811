"""Reachability kept by edits, generations of tables, and the order of an impact, against plain versions."""

import random

import pytest

from tessera.operators import graphs
from tessera.sources.generations import Generations
from tessera.streaming import sessions


@pytest.fixture
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def reached(edges, roots):
    found, todo = set(roots), list(roots)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in found:
                found.add(b)
                todo.append(b)
    return found


def test_reach_after_each_of_twenty_edits(few_tasks, tmp_path):
    """Additions, removals and both; removed cycles that hold each other, edges into roots, an edge that comes and goes."""
    spark, rng = few_tasks, random.Random(6)
    state = Generations(spark, str(tmp_path / "state"))
    roots = spark.createDataFrame([(0,), (7,)], "node long")
    apply, edges, seen = sessions.keep_reached(state, roots), set(), set()
    for n in range(20):
        edits = [(0, a, b, True) for a, b in ((0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (5, 6))] if n == 0 else []
        for k in range(rng.randint(1, 3)):
            gone = edges and rng.random() < 0.5
            a, b = rng.choice(sorted(edges)) if gone else (rng.randrange(10), rng.randrange(10))
            edits.append((1 + k, a, b, not gone))
        if n == 1:
            edits = [(1, 0, 1, False)]  # the cycle of 1, 2 and 3 holds itself
        if n == 5:
            edits = [(1, 0, 9, True), (2, 0, 9, False), (3, 5, 0, True)]
        for _, a, b, there in sorted(edits):
            (edges.add if there else edges.discard)((a, b))
        apply(spark.createDataFrame(edits, "seq int, src long, dst long, there boolean"), n)
        got = {r["node"] for r in state.read()["reached"].collect()}
        assert got == reached(edges, {0, 7}), (n, edits)
        seen.add(frozenset(got))
    apply(spark.createDataFrame([(1, 0, 5, True)], "seq int, src long, dst long, there boolean"), 19)  # given again
    assert {tuple(r) for r in state.read()["edges"].collect()} == edges and len(seen) >= 5


def test_a_failed_commit_leaves_the_generation_before(spark, tmp_path):
    root = str(tmp_path / "cache")
    store, one = Generations(spark, root, "rules 1"), spark.range(3).toDF("a")
    assert store.read() is None and store.commit({"x": one, "y": one.limit(1)}) == 0
    old = store.read()
    with pytest.raises(Exception, match="stop"):
        store.commit({"x": one.limit(1), "y": spark.sql("SELECT raise_error('stop') AS a")})
    assert {k: v.count() for k, v in store.read().items()} == {"x": 3, "y": 1}
    assert store.commit({"x": one.limit(2)}, why="second") == 1
    assert old["x"].count() == 3, "a reader that has begun goes on with its generation"
    assert {k: v.count() for k, v in store.read().items()} == {"x": 2} and store.newest()["notes"] == {"why": "second"}
    assert Generations(spark, root, "rules 2").read() is None
    store.commit({"x": one})
    assert len(list((tmp_path / "cache").glob("generation-*.json"))) == 2 and len(list((tmp_path / "cache").glob("tables-*"))) == 3  # with the failed one
    store._pointers = lambda found=store._pointers(): found[:-1]  # a writer that has looked before another one's commit
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit({"x": one})


def test_partition_order(few_tasks):
    """Slices by what joins affected nodes, layers by the longest way down; a cycle is one node; others don't count."""
    edges = {(2, 1), (3, 2), (4, 3), (4, 1), (5, 4), (3, 5), (11, 10), (12, 10), (13, 11), (13, 12), (30, 31), (10, 99), (1, 99), (20, 20)}
    spark = few_tasks
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {tuple(r) for r in graphs.partition_order(frame, spark.createDataFrame([(1,), (10,), (20,)], "node long")).collect()}
    assert got == {(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 2, 5), (10, 0, 10), (10, 1, 11), (10, 1, 12), (10, 2, 13), (20, 0, 20)}
    assert graphs.partition_order(frame, spark.createDataFrame([], "node long")).count() == 0


def test_connected_on_chains_and_random_graphs(few_tasks):
    rng = random.Random(5)
    order = rng.sample(range(60), 60)
    for edges in (set(zip(order, order[1:])), {(rng.randrange(50), rng.randrange(50)) for _ in range(30)}):
        got = {r["node"]: r["slice"] for r in graphs.connected(few_tasks.createDataFrame(sorted(edges), "src long, dst long"), few_tasks.range(60).toDF("node")).collect()}
        both = edges | {(b, a) for a, b in edges}
        assert got == {n: min(reached(both, {n})) for n in range(60)}
