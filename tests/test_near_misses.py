"""Near misses against all pairs, with the sets of a word dealt out in small groups."""

import random

import pytest

from tessera.operators import clones


@pytest.mark.parametrize("percent", [25, 60, 80])
def test_near_misses_are_all_pairs(spark, monkeypatch, percent):
    monkeypatch.setattr(clones, "WORD_GROUP", 3)
    rng = random.Random(percent)
    spans = [(i, [rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([4, 12, 26])]) for _ in range(rng.randint(0, 15))]) for i in range(120)]
    spans += [(200 + i, [f"w{j}" for j in range(i, 80 + i * 3)]) for i in range(12)] + [(300, None)]
    sets = {}
    for i, w in spans:
        if w:
            sets.setdefault(frozenset(w), i)
    expected = {(x, y, len(a & b), len(a | b)) for a, x in sets.items() for b, y in sets.items() if x < y and 100 * len(a & b) >= percent * len(a | b)}
    got = clones.near_misses(spark.createDataFrame(spans, "id long, w array<string>"), percent).collect()
    assert len(got) == len(expected) > 20 and {tuple(r) for r in got} == expected
