"""Resolution, graph, clone, style, mutation and finding operators on small inputs with known results."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.operators import clones, detectors, findings, graphs, mutation, resolution, security, styling


def table(spark, schema, *rows):
    return spark.createDataFrame(rows, schema)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_paths_and_specifiers(spark):
    for written, expected in (("a/./b/../c", "a/c"), ("../a", "a"), ("a//b/", "a/b"), ("", ""), (r"a\b", "a/b")):
        assert one(spark, resolution.normalise(F.col("p")), p=written) == expected
    kinds = {"./a": "relative", "..": "relative", "/a": "absolute", "#x": "private", "node:fs": "builtin", "https://x": "url", "@a/b/c": "scoped", "a/b": "package"}
    for s, kind in kinds.items():
        assert one(spark, resolution.specifier_kind(F.col("s")), s=s) == kind
    assert [one(spark, resolution.package_name(F.col("s")), s=s) for s in ("@a/b/c", "a/b", "./a")] == ["@a/b", "a", None]
    assert [one(spark, resolution.output_to_source(F.col("s"), "dist", "src"), s=s) for s in ("dist/a.js", "dist/a.d.ts", "lib/a.js")] == ["src/a.ts", "src/a.ts", None]
    assert [one(spark, resolution.strip_query(F.col("s")), s=s) for s in ("./a?raw", "#a", "./a#b")] == ["./a", "#a", "./a"]


def test_resolution_takes_the_first_candidate(spark):
    files = table(spark, "path string", ("src/a.ts",), ("src/a.js",), ("src/b/index.tsx",), ("lib/util/c.ts",), ("lib/util/deep/c.js",))
    asked = ["./a", "./a.js", "./b", "~/c", "~/deep/c", "pkg", "./gone", "./a?url"]
    imports = table(spark, "file string, source string", *[("src/main.ts", s) for s in [*asked, "./a"]])
    aliases = table(spark, "prefix string, target string", ("~", "lib/util"), ("~/deep", "lib/util/deep"))
    rows = resolution.resolve(imports, files, aliases).collect()
    assert len(rows) == 9
    assert {r.source: r.target for r in rows} == {
        "./a": "src/a.ts", "./a.js": "src/a.js", "./b": "src/b/index.tsx", "~/c": "lib/util/c.ts", "~/deep/c": "lib/util/deep/c.js", "pkg": None, "./gone": None, "./a?url": "src/a.ts",
    }
    assert [r.source for r in resolution.unresolved(resolution.resolve(imports, files)).collect()] == ["./gone"]


def test_exports_map(spark):
    e = table(
        spark, "package string, key string, ordinal int, condition string, target string", ("p", ".", 0, "types", "t.d.ts"), ("p", ".", 1, "import", "m.mjs"), ("p", ".", 2, "default", "m.js"),
        ("p", "./f/*", 0, "import", "f/*.js"), ("p", "./f/in/*", 0, "import", None),
    )
    asked = table(spark, "package string, subpath string", ("p", "."), ("p", "./f/x"), ("p", "./f/in/y"), ("p", "./none"))
    got = {r.subpath: r.target for r in resolution.export_targets(asked, e, ["import", "default"]).collect()}
    assert got == {".": "m.mjs", "./f/x": "f/x.js", "./f/in/y": None}


def test_dominators_and_cycles_against_brute_force(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(20)})
    edges = table(spark, "src long, dst long", *pairs)

    def reach(without):
        seen, todo = {0}, [0]
        while todo:
            at = todo.pop()
            for a, b in pairs:
                if a == at and b not in seen and without not in (a, b):
                    seen.add(b)
                    todo.append(b)
        return seen

    full = reach(None)
    expected = {(n, d) for n in full for d in full if d in (n, 0) or n not in reach(d)}
    assert {tuple(r) for r in graphs.dominators(edges, 0).collect()} == expected
    cycles = {
        ">".join(map(str, p)) for k in (2, 3, 4) for p in itertools.permutations(range(9), k)
        if p[0] == min(p) and all((p[i], p[(i + 1) % k]) in pairs for i in range(k))
    }
    assert {r.cycle for r in graphs.elementary_cycles(edges, 4).collect()} == cycles


def test_routes_stop_at_shadowed_and_ambiguous_names(spark):
    own = table(spark, "file string, name string", ("a", "x"), ("d", "x"))
    r = table(spark, "file string, exported string, source string, imported string", ("b", "y", "a", "x"), ("c", "y", "b", "y"), ("d", "x", "a", "x"), ("e", "x", "a", "x"), ("e", "x", "d", "x"))
    assert {tuple(x) for x in graphs.re_export_routes(own, r, "x", "a").collect()} == {("a", "x"), ("b", "y"), ("c", "y")}


def test_prop_drilling(spark):
    f = table(spark, "src string, prop string, dst string", *[(a, "p", b) for a, b in zip("abc", "bcd")], ("a", "q", "b"))
    roots = table(spark, "node string, prop string", ("a", "p"), ("a", "q"))
    assert [tuple(r) for r in detectors.drilled(f, roots).collect()] == [("a", "p", "d", 3)]


def test_clones(spark):
    w = spark.createDataFrame([(1, list("abcdef")), (2, list("xbcdey")), (3, list("abcdef")), (4, []), (5, None)], "doc_id long, w array<string>")
    got = {tuple(r) for r in clones.first_copies(w, 3).collect()}
    assert got == {(2, 1, 4, 1, 1), (3, 0, 5, 1, 0)}
    assert one(spark, clones.name_pattern(F.split("s", " ")), s="a b a c") == [1, 2, 1, 4]
    assert tuple(one(spark, clones.line_and_column(F.col("s"), F.col("o")), s="ab\ncd\n", o=4)) == (2, 1)
    assert one(spark, clones.tokens(F.col("s"), "semantic"), s='Let x = "a b" + 12') == ["$n", "$n", "=", "$s", "+", "$0"]
    spans = table(spark, "doc_id long, first long, last long", (1, 0, 9), (1, 2, 5), (1, 4, 12), (1, 0, 9), (2, 2, 5), (1, 0, 3))
    assert {tuple(r) for r in clones.without_contained(spans).collect()} == {(1, 0, 9), (1, 4, 12), (2, 2, 5)}


def test_findings(spark):
    f = table(spark, "path string, line long", ("a", 5), ("a", 50), ("b", 1), (None, None), ("a", None), ("b", None))
    ranges = table(spark, "path string, first long, last long", ("a", 3, 7))
    assert sorted(map(str, (tuple(r) for r in findings.in_diff(f, ranges).collect()))) == sorted(map(str, [("a", 5), ("a", None), (None, None)]))
    new = table(spark, "k string, severity string", *[("x", s) for s in ("low", "low", "high", "medium")])
    base = table(spark, "k string, severity string", ("x", "low"), ("x", "high"))
    assert tuple(findings.baseline_slots(new, base, "k").first()) == ("x", 0, 1, 1)
    kept, used = findings.ignore(table(spark, "n string", ("ab",), ("cd",), (None,)), "n", ["a*", "z"])
    assert {r.n for r in kept.collect()} == {"cd", None} and {tuple(r) for r in used.collect()} == {("a*", 1), ("z", 0)}
    marks = table(spark, "file string, line long, rule string", ("a", 1, "r"), ("a", 2, None), ("b", None, None), ("a", None, "q"))
    live = table(spark, "file string, line long, rule string", ("a", 1, "r"))
    assert {tuple(r) for r in findings.stale_markers(marks, live).collect()} == {("a", 2, None), ("b", None, None), ("a", None, "q")}


def test_styles(spark):
    assert one(spark, styling.class_tokens(F.col("s")), s="""<p class="a  b"><i className='c a'><b class={x}>""") == ["a", "b", "c"]
    assert one(spark, styling.defined_classes(F.col("s")), s=".a:hover, p.b-c { margin: .5em } /* .no */ .d{background:url(x.png)}") == ["a", "b-c", "d"]
    used = table(spark, "name string, dynamic boolean", ("a", False), (None, False))
    defined = table(spark, "name string", ("b",))
    assert {tuple(r) for r in styling.class_findings(used, defined).collect()} == {("a", "unresolved"), ("b", "unreferenced")}
    assert {tuple(r) for r in styling.class_findings(used.union(table(spark, "name string, dynamic boolean", (None, True))), defined).collect()} == {("a", "unresolved")}
    t = styling.theme_tokens(table(spark, "k int, css string", (1, ":root{--a: 1; --b:2} p{color:var(--a)} i{x:var( --c)}")), "k", "css")
    assert {tuple(r) for r in t.collect()} == {("--a", 1, 1), ("--b", 1, 0), ("--c", 0, 1)}


def test_mutants_and_secrets(spark):
    assert one(spark, mutation.pattern_mutants(F.col("s")), s=r"^[a-z]+\d$") == [r"[a-z]+\d$", r"^[a-z]+\d", r"^[a-z]*\d$", r"^[a-z]+\D$", r"^[^a-z]+\d$"]
    public = {"API_KEY": False, "apiToken": False, "NEXT_PUBLIC_TOKEN": True, "DB_PASSWORD": False, "NODE_ENV": True, "GIT_SHA": True, "MY.REF": True, "REF_TOKEN": False, "BASIC_AUTH_TAG": False, "TAGS": False, "git_sha": False}
    assert {n: one(spark, security.public_variable(F.col("s")), s=n) for n in public} == public
    paths = {"process.env.AWS_ACCESS_KEY_ID": True, "import.meta.env.VITE_X": False, "import.meta.env.DB_PASS": True, "req.query.id": False, "process.env.MODE": False}
    assert {n: one(spark, security.secret_source(F.col("s")), s=n) for n in paths} == paths


def test_hints_by_line(spark):
    from tessera.operators import mutation

    mutants = spark.createDataFrame([(1, 5, "a"), (1, 200, "b"), (2, 5, "c")], "file long, line long, m string")
    hints = spark.createDataFrame([(1, 1, 300, "wide"), (1, 199, 201, "near"), (1, 6, 9, "beside")], "file long, first long, last long, hint string")
    got = {r["m"]: r["hint"] for r in mutation.hinted(mutants, hints).collect()}
    assert got == {"a": "wide", "b": "near", "c": None}
