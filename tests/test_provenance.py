"""Origins of called values and proofs made out of place, against a plain depth-first walk."""

import random

import pytest

from tessera.operators import provenance

BINDING = "file string, scope string, name string, imported string, source string, target string"


def walk(bindings, file, symbol):
    """Origin of a local symbol by recursion; a key that is under way is unknown."""

    def merge(found):
        found = {x for x in found if x != provenance.MISSING}
        return provenance.MISSING if not found else found.pop() if len(found) == 1 else provenance.UNKNOWN

    def of(key, way):
        file, scope, symbol = key
        if key in way:
            return provenance.UNKNOWN
        head, _, rest = symbol.partition(".")
        rows = {b for b in bindings if b[:3] == (file, scope, head) and head != "*"}
        if not rows and scope == "local":
            return f"{file}#{symbol}"
        stars = not rows
        if stars:
            rows = {b for b in bindings if b[:3] == (file, "export", "*")} if head != "default" else set()
        found = []
        for _, _, _, imported, source, target in rows:
            on = symbol if stars or imported is None else rest if imported == "*" else ".".join(x for x in (imported, rest) if x)
            if source is None and target is None:
                found.append(f"{file}#{symbol}" if imported is None else of((file, "local", on), {*way, key}))
            elif not on or (target is None and source[0] in "./#"):
                found.append(provenance.UNKNOWN)
            else:
                found.append(f"{source}#{on}" if target is None else of((target, "export", on), {*way, key}))
        return merge(found)

    return of((file, "local", symbol), frozenset())


def origins(spark, bindings, wanted, **more):
    table = spark.createDataFrame(list(bindings), BINDING)
    asked = spark.createDataFrame(wanted, "file string, symbol string")
    return {(r.file, r.symbol): r.origin for r in provenance.value_origins(asked, table, **more).collect()}


BINDINGS = {
    ("use", "local", "p", "make", "./mid", "mid"), ("use", "local", "ns", "*", "./mid", "mid"), ("use", "local", "raw", "make", "./gone", None),
    ("use", "local", "own", "helper", "./mid", "mid"), ("use", "local", "d", "default", "./mid", "mid"), ("use", "local", "no", "absent", "./mid", "mid"),
    ("use", "local", "twice", "two", "./mid", "mid"), ("use", "local", "ring", "ring", "./mid", "mid"), ("use", "local", "anon", "default", "./end", "end"),
    ("mid", "export", "make", "build", "./end", "end"), ("mid", "export", "*", None, "./end", "end"), ("mid", "export", "*", None, "./other", "other"),
    ("mid", "export", "helper", "helper", None, None), ("mid", "export", "two", "build", "./end", "end"), ("mid", "export", "two", "x", "pkg", None),
    ("mid", "export", "ring", "ring", "./back", "back"), ("back", "export", "ring", "ring", "./mid", "mid"), ("mid", "export", "all", "*", "./end", "end"),
    ("end", "export", "build", "b", None, None), ("end", "local", "b", "defineIt", "kit", None), ("end", "export", "default", None, None, None),
    ("other", "export", "star", "s", "kit", None),
}


def test_ways_to_an_origin(spark):
    expected = {
        "p": "kit#defineIt", "ns.make": "kit#defineIt", "ns": "?", "raw": "?", "own": "mid#helper", "d": "-", "no": "-", "twice": "?", "ring": "?",
        "anon": "end#default", "ns.star": "kit#s", "ns.star.deep": "kit#s.deep", "ns.all.build": "kit#defineIt", "ns.all": "?", "mine.x": "use#mine.x",
    }
    got = origins(spark, BINDINGS, [("use", x) for x in expected] * 2 + [("use", None), (None, "p"), ("use", "")])
    assert got == {("use", k): v for k, v in expected.items()}
    assert {k[1]: walk(BINDINGS, *k) for k in got} == expected


def test_steps_are_bounded(spark):
    chain = {(str(i), "export", "x", "x", "./n", str(i + 1)) for i in range(9)} | {("u", "local", "x", "x", "./n", "0"), ("9", "export", "x", "y", "kit", None)}
    assert origins(spark, chain, [("u", "x")], depth=12) == {("u", "x"): "kit#y"}
    assert origins(spark, chain, [("u", "x")], depth=4) == {("u", "x"): "?"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_modules(spark, seed):
    r = random.Random(seed)
    files, names, bindings = "abcdef", ["x", "y", "default"], set()
    for _ in range(34):
        at, name, to = r.choice(files), r.choice([*names, "*"]), r.choice(files)
        if name != "*" and r.random() < 0.2:
            bindings.add((at, "export", name, r.choice(["x", "y", None]), None, None))
        elif r.random() < 0.25:
            bindings.add((at, "export", name, None if name == "*" else r.choice(names), r.choice(["kit", "lib", "./gone"]), None))
        else:
            bindings.add((at, "export", name, None if name == "*" else r.choice([*names, "*"]), "./to", to))
    bindings |= {("u" + f, "local", n, n, "./to", f) for f in files for n in ("x", "y")} | {("u" + f, "local", "ns", "*", "./to", f) for f in files}
    wanted = [("u" + f, s) for f in files for s in ("x", "y", "ns.x", "ns.default", "x.m")]
    assert origins(spark, bindings, wanted) == {k: walk(bindings, *k) for k in wanted}


def test_empty(spark):
    assert origins(spark, [], [("a", "x")]) == {("a", "x"): "a#x"}
    assert origins(spark, BINDINGS, []) == {}


def test_proofs_out_of_place(spark):
    calls = spark.createDataFrame([(1, "use", "p", "kind"), (2, "use", "p", None), (3, "end", "b", "kind"), (4, "use", "own", "kind"), (4, "use", "own", "kind"), (5, "use", "ns.make", "else")], "id long, file string, callee string, argument string")
    rules = spark.createDataFrame([("all", None), ("some", ["kind", "kind"]), ("none", [])], "rule string, kinds array<string>")
    allowed = spark.createDataFrame([("all", "end"), ("none", "use"), ("none", "end")], "rule string, file string")
    got = provenance.unproven_producers(calls, spark.createDataFrame(list(BINDINGS), BINDING), rules, allowed, "kit#defineIt")
    assert sorted((r.id, r.rule) for r in got.collect()) == [(1, "all"), (1, "some"), (2, "all"), (3, "some"), (5, "all")]
