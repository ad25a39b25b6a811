"""Near misses of sets with frequent words: what is shuffled grows with the words, not with the pairs of a word's sets."""

from tessera.operators import clones


def shuffled(spark) -> int:
    """Records that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    empty = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(empty(), False, False, sc._gateway.new_array(sc._jvm.double, 0), empty())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_frequent_words_are_not_repeated_for_their_sets(spark, monkeypatch):
    monkeypatch.setattr(clones, "WORD_GROUP", 3)
    spans = [(i, ["the", "of", "and", f"a{i // 2}", f"b{i // 2}", f"c{i}"]) for i in range(400)]
    frame = spark.createDataFrame(spans, "id long, w array<string>")
    before = shuffled(spark)
    got = clones.near_misses(frame, 45).collect()
    assert {tuple(r) for r in got} == {(i, i + 1, 5, 7) for i in range(0, 400, 2)} and len(got) == 200
    assert shuffled(spark) - before < 10 * 6 * 400


def test_pairs_within_and_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(clones, "BLOCK_WORDS", 200, raising=False)
    monkeypatch.setattr(clones, "PAIRS_AT_ONCE", 50, raising=False)
    spans = [(i, [f"w{j}" for j in range(i % 40, i % 40 + 3 + i % 11)]) for i in range(150)] + [(500, []), (501, None)]
    sets = {}
    for i, w in spans:
        if w:
            sets.setdefault(frozenset(w), i)
    expected = {(x, y, len(a & b), len(a | b)) for a, x in sets.items() for b, y in sets.items() if x < y and 10 * len(a & b) >= 3 * len(a | b)}
    got = clones.near_misses(spark.createDataFrame(spans, "id long, w array<string>"), 30).collect()
    assert len(got) == len(expected) > 100 and {tuple(r) for r in got} == expected
