"""One-to-one stretches of pairs held as arrays: alike for any number of words at a time, and without a shuffle."""

import random

import pytest

from tessera.operators import clones
from tessera.plans import QUERIES


def plain(left, right, least):
    """First and length of each maximal stretch, by comparing each place with all before it."""
    first, found = 0, {}
    for k in range(min(len(left), len(right))):
        told = [i for i in range(k) if None not in (left[i], right[i], left[k], right[k]) and (left[i] == left[k]) != (right[i] == right[k])]
        first = max(first, told[-1] + 1 if told else 0)
        found[first] = k + 1 - first
    return {(f, n) for f, n in found.items() if n >= least}


@pytest.mark.parametrize("at_once", [1, 30, 1 << 17])
def test_stretches_of_arrays_and_of_rows(spark, monkeypatch, at_once):
    monkeypatch.setattr(clones, "WORDS_AT_ONCE", at_once)
    rng = random.Random(7)
    names = lambda: [rng.choice(["a", "b", "ç", "d", "e", "f", None]) for _ in range(rng.randint(0, 25))]
    pairs = [(f"p{i}", names(), names()) for i in range(120)] + [("none", None, list("abcd")), ("other", list("abcd"), None), ("empty", [], []), ("nulls", [None] * 9, [None] * 9)]
    expected = {(p, *x) for p, a, b in pairs for x in plain(a or [], b or [], 3)}
    got = clones.one_to_one_stretches(spark.createDataFrame(pairs, "pair string, left array<string>, right array<string>"), 3).collect()
    assert len(got) == len(expected) > 50 and {tuple(r) for r in got} == expected
    places = [(p, k, a[k], b[k]) for p, a, b in pairs for k in range(min(len(a or []), len(b or [])))]
    rows = spark.createDataFrame(places, "pair string, pos int, left string, right string").repartition(5)
    got = clones.one_to_one_windows(rows, 3).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_query_deals_out_documents_only(spark, sf_dir):
    plan = QUERIES["renamed_windows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
