"""Lines of every length, with a bound that grows with the line, against brute force."""

import random
import re

import pandas as pd

from tessera.llm import line_dedup
from tessera.llm.common import Scratch


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def bound(n):
    return 0 if n < 5 else 1 if n < 20 else n // 10


def texts():
    rng, out = random.Random(7), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    for n in [1, 3, 5, 7, 9, 12, 19, 20, 23, 29, 30, 34, 47, 60, 75]:
        for _ in range(2):
            base = [word() for _ in range(n)]
            for edits in (0, 0, 1, 2, n // 10, n // 10 + 1):
                cur = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(cur) + 1)
                    cur[at : at + rng.choice([0, 1, 1])] = [word()] * rng.choice([0, 1, 1])
                out.append(" ".join(cur))
    rng.shuffle(out)
    return ["\n".join(out[i : i + 4]) for i in range(0, len(out), 4)]


def kept(rows):
    before, out = [], {}
    for i, t in enumerate(rows):
        stay = []
        for line in t.split("\n"):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            if not w or not any(w == o or distance(w, o) <= bound(min(len(w), len(o))) for o in before):
                stay.append(line)
            before.append(w)
        out[i] = "\n".join(stay)
    return out


def test_whole_line_dedup(spark):
    rows = texts()
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(rows)), "text": rows}))
    got = line_dedup.dedup_lines(spark, docs, Scratch(spark, "lines"), whole=True).toPandas()
    assert dict(zip(got["doc_id"], got["text"])) == kept(rows)


def test_word_edits():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        for k in (0, 1, 3, 9):
            assert line_dedup.word_edits(a, b, k) == min(distance(a, b), k + 1)


def test_lines_within_the_bound_share_a_key_in_any_order_of_grams(spark):
    """Keys are few, 2 k + 1 a line, and cover every pair; before, a line had nearly a key a word."""
    import numpy as np

    rows = texts() + ["é x\n" + " ".join(["x"] * 25), "", "\n" + " ".join(["x"] * 27) + "\t\n"]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(rows)), "text": rows}))
    counts = np.random.default_rng(2).integers(0, 50, 1 << line_dedup.BUCKET_BITS).astype(np.int32)
    got = line_dedup._keyed_lines(line_dedup.keyed_documents(docs), counts).toPandas()
    split = lambda line: re.findall(r"[^\x20\x09-\x0D]+", line)
    lines = {(d, i): split(line) for d, t in enumerate(rows) for i, line in enumerate(t.split("\n")) if len(split(line)) >= 20}
    keys = {(r.d, r.pos): set(r["keys"]) for _, r in got.iterrows()}
    assert {(r.d, r.pos): r.n for r in got.itertuples()} == {at: len(w) for at, w in lines.items()}
    assert all(1 <= len(keys[at]) <= 2 * (len(w) // 10) + 1 for at, w in lines.items())
    for at, w in lines.items():
        for other, o in lines.items():
            if distance(w, o) <= bound(min(len(w), len(o))):
                assert keys[at] & keys[other]
                assert line_dedup._may_be_within(w, o, bound(min(len(w), len(o))))


def test_only_rows_that_are_used_are_joined_again(spark, monkeypatch):
    """A row holds no copy of the earliest line of its key, and keys of two lines aren't joined again; no pair is lost."""
    import numpy as np

    seen, save = {}, Scratch.save
    # any order of grams; by their counts, those that only two lines have would come first
    monkeypatch.setattr(line_dedup, "_gram_counts", lambda rows: np.zeros(1 << line_dedup.BUCKET_BITS, np.int32))

    def saved(self, df, name):
        out = save(self, df, name)
        if name == "members":
            seen["rows"] = out.collect()
        return out

    monkeypatch.setattr(Scratch, "save", saved)

    def check(rows):
        docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(rows)), "text": rows}))
        got = line_dedup.dedup_lines(spark, docs, Scratch(spark, "lines"), whole=True).toPandas()
        assert dict(zip(got["doc_id"], got["text"])) == kept(rows)
        return seen["rows"], sum(not t for t in got["text"])

    changed = lambda line, *at: " ".join(f"{w}x" if i in at else w for i, w in enumerate(line.split()))
    base = [" ".join(f"{c}{i}" for i in range(29)) for c in "abcdef"]
    two, dropped = check([f(line) for line in base for f in (str, lambda x: changed(x, 3, 20))])
    assert two and not any(r["open"] for r in two) and all(r["leader"]["d"] < r["x"]["at"]["d"] for r in two) and dropped == 6
    # the last of three is near the second only, and the earliest line of the keys is near neither
    three, dropped = check([f(line) for line in base for f in (str, lambda x: changed(x, 2, 14, 27), lambda x: changed(x, 2, 8, 14, 20, 27))])
    assert any(r["open"] for r in three) and all(r["leader"] or r["open"] for r in three) and dropped == 6


def test_keys_meet_in_slices(spark, monkeypatch):
    """Of many lines a slice of the keys is written at a time, and no pair is lost; before, all keys met at once."""
    monkeypatch.setattr(line_dedup, "FEW_LINES", 10, raising=False)
    rows, save, keys = texts(), Scratch.save, []

    def saved(self, df, name):
        out = save(self, df, name)
        if name == "keys":
            keys.append({r["key"] for r in out.select("key").distinct().collect()})
        return out

    monkeypatch.setattr(Scratch, "save", saved)
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(rows)), "text": rows}))
    got = line_dedup.dedup_lines(spark, docs, Scratch(spark, "lines"), whole=True).toPandas()
    assert dict(zip(got["doc_id"], got["text"])) == kept(rows)
    every = set().union(*keys)
    assert len(keys) > 1 and all(0 < len(k) < len(every) / 2 for k in keys) and sum(map(len, keys)) == len(every)
