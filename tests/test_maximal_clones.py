"""Maximal clone groups against a listing of all substrings."""

import random

import pytest

from tessera.operators import clones


def plain(files, width):
    """{(group's instances)}: maximal repeats of `width` tokens or more, without windows that overlap an equal one."""
    kept = {}
    for d, w in files.items():
        seen = {}
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if p - seen.get(key, -width) >= width:
                kept.setdefault(key, []).append((d, p))
            seen[key] = p
    alive = {at for many in kept.values() if len(many) > 1 for at in many}
    found = {}
    for d, p in alive:
        q = p
        while (d, q) in alive:
            found.setdefault(tuple(files[d][p : q + width]), set()).add((d, p))
            q += 1
    out = set()
    for text, at in found.items():
        n = len(text)
        before = {files[d][p - 1] if (d, p - 1) in alive else (d, p) for d, p in at}
        after = {files[d][p + n] if (d, p + n - width + 1) in alive else (d, p) for d, p in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            out.add((n, tuple(sorted(at))))
    return out


def grouped(rows):
    found = {}
    for r in rows:
        found.setdefault((r["of_doc"], r["of_first"], r["last"] - r["first"] + 1), []).append((r["doc_id"], r["first"], r["instances"]))
    assert all(len(v) == v[0][2] for v in found.values())
    return {(k[2], tuple(sorted((d, p) for d, p, _ in v))) for k, v in found.items()}


def corpora():
    rng = random.Random(3)
    yield {1: list("abcdefgh"), 2: list("xabcdefy"), 3: list("zcdefq"), 4: [], 5: list("ab")}, 3
    yield {1: list("a" * 30), 2: list("aaaa" * 3 + "b"), 3: list("abcd" * 6), 4: list("abcdabcd")}, 3
    for size in (2, 3, 6):
        yield {d: [rng.choice("abcdefgh"[:size]) for _ in range(rng.randint(0, 60))] for d in range(8)}, 4
    base = [rng.choice("abcdefghijkl") for _ in range(120)]
    yield {d: base[rng.randrange(60) : 60 + rng.randrange(60)] + [rng.choice("abc")] + base[: rng.randrange(40)] for d in range(12)} | {50: base, 51: base}, 5


@pytest.mark.parametrize("files, width", list(corpora()))
def test_groups_are_all_maximal_repeats(spark, files, width):
    words = spark.createDataFrame([(d, w) for d, w in files.items()], "doc_id long, w array<string>")
    got, expected = grouped(clones.maximal_groups(words, width).collect()), plain(files, width)
    assert got == expected and len(expected) > 1


def test_groups_by_lines_and_null_files(spark):
    words = spark.createDataFrame([("a", list("klmnop")), ("b", list("xklmnoy")), ("c", None), ("d", list("zklmz"))], "doc_id string, w array<string>")
    found = clones.maximal_groups(words, 3)
    lines = spark.createDataFrame([(d, p, p // 2) for d in "abd" for p in range(8)], "doc_id string, pos long, line long")
    rows = clones.long_enough(found, lines, 3).collect()
    assert {(r["doc_id"], r["first"], r["last"]) for r in rows} == {("a", 0, 4), ("b", 1, 5)} and {r["of_doc"] for r in rows} == {"a"}
    assert clones.maximal_groups(words.limit(0), 3).count() == 0


def test_one_to_one_windows_are_the_longest(spark):
    """Against all stretches: those without a conflict that no longer one holds."""
    rng, rows, expected = random.Random(8), [], set()
    for pair in range(25):
        n = rng.randint(0, 14)
        both = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", None])) for _ in range(n)]
        rows += [(pair, i, a, b) for i, (a, b) in enumerate(both)]

        def fits(s, e, both=both):
            seen = [(a, b) for a, b in both[s:e] if a and b]
            return all((a == c) == (b == d) for a, b in seen for c, d in seen)

        good = [(s, e) for s in range(n) for e in range(s + 1, n + 1) if fits(s, e)]
        expected |= {(pair, s, e - s) for s, e in good if e - s >= 2 and not any(a <= s and e <= b and (a, b) != (s, e) for a, b in good)}
    pairs = spark.createDataFrame(rows, "pair int, pos int, left string, right string")
    assert {tuple(r) for r in clones.one_to_one_windows(pairs, 2).collect()} == expected and len(expected) > 20
    assert clones.one_to_one_windows(pairs.limit(0), 2).count() == 0
