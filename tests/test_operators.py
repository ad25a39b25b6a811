"""Operators on small inputs with known results."""

import random

from tessera.operators import clones, detectors, graphs, metrics


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_fan_leaves_out_self_and_repeats(spark):
    got = {r.node: (r.fan_in, r.fan_out) for r in graphs.fan(edges(spark, [(1, 1), (2, 1), (2, 1), (3, 1)])).collect()}
    assert got == {1: (2, 0), 2: (0, 1), 3: (0, 1)}


def test_path_ties_take_the_smallest(spark):
    got = {r.node: r.path for r in graphs.shortest_paths(edges(spark, [(0, 2), (0, 1), (1, 3), (2, 3)]), 0).collect()}
    assert got == {0: "0", 1: "0>1", 2: "0>2", 3: "0>1>3"}


def test_strong_components_against_closure(spark):
    assert {tuple(r) for r in graphs.strong_components(edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)])).collect()} == {(1, 1), (2, 1), (3, 1)}
    rng = random.Random(2)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)]
    reach = {(a, b) for a, b in pairs}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    expected = {}
    for a in range(12):
        mutual = [b for b in range(12) if b != a and (a, b) in reach and (b, a) in reach]
        if mutual:
            expected[a] = min([a, *mutual])
    assert {r.node: r.component for r in graphs.strong_components(edges(spark, pairs)).collect()} == expected


def test_coupling_leaves_out_static_edges(spark):
    rows = [(f"{k}{i}", p) for i in range(6) for k, pair in (("x", "ab"), ("y", "cd")) for p in pair]
    changes = spark.createDataFrame(rows, "commit string, path string")
    static = spark.createDataFrame([("c", "d")], "a string, b string")
    assert [tuple(r) for r in metrics.change_coupling(changes, static).collect()] == [("a", "b", 6, 1.0)]


def test_percentile_rule(spark):
    for counts, expected in ((range(1, 21), (19, 19, 5.0, 20)), ([3] * 10, (3, 10, 0.0, 3))):
        uses = spark.createDataFrame([(i, u) for i, n in enumerate(counts) for u in range(n)], "node long, user long")
        nodes = spark.createDataFrame([(i,) for i in range(len(list(counts)))], "node long")
        assert tuple(detectors.fan_in_summary(nodes, uses, "node", "user").first()) == expected


def test_coverage_of_nothing_is_full(spark):
    from pyspark.sql import functions as F

    assert metrics.coverage_summary(spark.range(0), F.lit(True)).first().percent == 100.0


def test_typos(spark):
    names, known = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (["card-titel", "ab"], ["card-title", "ac"]))
    assert [tuple(r) for r in detectors.closest_names(names, known).collect()] == [("card-titel", "card-title", 2)]


def test_windows_keep_both_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "z a b c"), (3, "q r s t"), (4, None)], "doc_id long, text string")
    assert {tuple(r) for r in clones.repeated_windows(docs, 3).collect()} == {(1, 2, 1), (2, 2, 1), (3, 2, 0)}
