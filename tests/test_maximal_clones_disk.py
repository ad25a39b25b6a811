"""Maximal repeats of a long text in many stretches: what is shuffled grows with the words, not with the stretches' sequences."""

import pytest

from test_maximal_clones import grouped, plain
from test_near_misses_disk import shuffled

from tessera.operators import clones


def files(n):
    base = [f"w{i}" for i in range(n)]
    return {0: base, 1: base} | {2 + p: [f"a{p}", *base[p : p + 4], f"b{p}"] for p in range(0, n - 4, 8)}


@pytest.mark.parametrize("n, bound", [(200, None), (1600, 20)])
def test_sequences_are_not_written(spark, n, bound):
    texts = files(n)
    words = spark.createDataFrame(list(texts.items()), "doc_id long, w array<string>")
    before = shuffled(spark)
    got = grouped(clones.maximal_groups(words, 3).collect())
    if bound:
        assert shuffled(spark) - before < bound * sum(map(len, texts.values()))
    else:
        assert got == plain(texts, 3)
    assert len(got) == 1 + len(texts) - 2
