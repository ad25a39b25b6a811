"""Hashes of windows don't depend on how many files a task takes at a time."""

import random

import pytest

from tessera.operators import clones


@pytest.mark.parametrize("at_once", [1, 25, 1 << 17])
def test_windows_of_files_taken_few_at_a_time(spark, monkeypatch, at_once):
    monkeypatch.setattr(clones, "WORDS_AT_ONCE", at_once)
    rng = random.Random(5)
    files = {d: [rng.choice("ab") + "é" * rng.randint(0, 1) for _ in range(rng.randint(0, 20))] for d in range(60)} | {60: [], 61: None, 62: ["a"] * 40}
    words = spark.createDataFrame(list(files.items()), "doc_id long, w array<string>").repartition(2)
    rows = clones.window_hashes(words, 3).collect()
    expected = {(d, p): tuple(w[p : p + 3]) for d, w in files.items() for p in range(len(w or []) - 2)}
    assert len(rows) == len(expected) and {(r["doc_id"], r["pos"]) for r in rows} == set(expected)
    of = {}
    for r in rows:
        of.setdefault(r["h"], set()).add(expected[r["doc_id"], r["pos"]])
    assert all(len(x) == 1 for x in of.values()) and len(of) == len(set(expected.values()))
