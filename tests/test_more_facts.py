"""Logs read in splits, deltas of cycles and zones, aliases of one binding, and estimated coverage."""

import random
import subprocess

from pyspark.sql import functions as F

from tessera.operators import detectors, extensions, findings, metrics, results
from tessera.sources import code, markup


def test_log_read_in_splits(spark, tmp_path):
    """A log of many splits, with an empty commit, a binary file, a path with a line break and a tab in it, none apart."""
    def block(i):
        files = f"\n{i}\t1\tsrc/a{i}.ts\0-\t-\tlogo.png\0" + ("2\t0\todd\n\tname\0" if i % 7 == 0 else "")
        return f"{1700000000 + i}|{1700000100 + i}|{i:040x}|ann@x.y|z\0" + ("" if i % 5 == 0 else files)

    (tmp_path / "log").write_text("\0".join(block(i) for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = code.read_history(spark, str(tmp_path / "log"))
        assert got.rdd.getNumPartitions() > 10
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = []
    for i in range(2000):
        if i % 5:
            expected += [(i, f"src/a{i}.ts", i, 1), (i, "logo.png", 0, 0)] + ([(i, "odd\n\tname", 2, 0)] if i % 7 == 0 else [])
    assert sorted((int(r.commit, 16), r.path, r.added, r.deleted) for r in rows) == sorted(expected)
    assert {r.author for r in rows} == {"ann@x.y|z"}
    assert all(r.committed.timestamp() - r.ts.timestamp() == 100 for r in rows)


def test_log_of_a_repository(spark, tmp_path):
    def git(*args):
        return subprocess.run(["git", "-c", "user.email=a@b.c", "-c", "user.name=n", *args], cwd=tmp_path, check=True, capture_output=True).stdout

    git("init", "-q")
    for n, name in enumerate(["a.ts", "b c.ts"]):
        (tmp_path / name).write_text("x\n" * (n + 1))
        git("add", ".")
        git("commit", "-qm", name)
        git("commit", "-q", "--allow-empty", "-m", "none")
    (tmp_path / "log").write_bytes(git("log", "--numstat", "--no-merges", "--no-renames", "-z", "--format=format:%at|%ct|%H|%aE%x00"))
    rows = code.read_history(spark, str(tmp_path / "log")).collect()
    assert sorted((r.path, r.added, r.author) for r in rows) == [("a.ts", 1, "a@b.c"), ("b c.ts", 2, "a@b.c")]
    (tmp_path / "none").write_text("")
    assert code.read_history(spark, str(tmp_path / "none")).count() == 0


def test_introduced(spark):
    table = lambda rows: spark.createDataFrame(rows, "cycle int, file string")
    head = table([(1, "b"), (1, "a"), (2, "c"), (2, "d"), (3, "d"), (3, "c"), (4, None), (5, "a"), (5, "b"), (5, "c")])
    base = table([(9, "a"), (9, "b"), (9, "a")])
    assert sorted(r.key for r in results.introduced_cycles(head, base).collect()) == ["a|b|c", "c|d"]
    zones = lambda rows: spark.createDataFrame(rows, "from_zone string, to_zone string")
    got = results.introduced_zone_pairs(zones([("ui", "db"), ("ui", "db"), ("app", "db"), ("app", "db")]), zones([("ui", "db")]))
    assert [tuple(r) for r in got.collect()] == [("app", "db", 2)]


def test_aliases_of_one_binding(spark):
    rows = [
        ("a", "x", None, None, False, 1), ("a", "y", "x", None, False, 5), ("a", "y", "x", None, False, 9), ("a", "default", None, None, False, 3),
        ("b", "T", None, None, True, 1), ("b", "U", "T", None, False, 2), ("b", "v", "w", None, False, 3), ("b", "V", "w", None, True, 4),
        ("c", "m", "n", "./d", False, 7), ("c", "default", "n", "./d", False, 2), ("c", "k", "n", "./e", False, 1), ("c", "*", "*", "./d", False, 0),
        ("d", "p", "q", None, False, 1), ("d", "r", "q", None, False, 2), ("e", "p", "q", None, False, 1), ("e", "r", "q", None, False, 2), ("f", "p", "q", None, False, None), ("f", "r", "q", None, False, 1),
    ]
    exports = spark.createDataFrame(rows, "file string, name string, local string, source string, type_only boolean, place int")
    ignored = spark.createDataFrame([("d", "r"), ("e", "*"), ("d", "r")], "file string, name string")
    got = {(r.file, r.local, r.source): r.names for r in detectors.export_aliases(exports, ignored).collect()}
    assert got == {("a", "x", None): ["x", "y"], ("b", "T", None): ["T", "U"], ("c", "n", "./d"): ["default", "m"]}


def test_estimated_scores(spark):
    f = spark.createDataFrame([("a", "f", True, 5), ("a", "g", False, 5), ("b", "h", True, 5), ("a", "m", True, 5), ("a", "z", True, 5)], "path string, name string, exported boolean, complexity int")
    measured = spark.createDataFrame([("a", "m", 1, 4), ("a", "m", 1, 0), ("a", "z", 0, 0)], "path string, name string, covered long, statements long")
    reach = spark.createDataFrame([("a", "f"), ("a", "g"), ("a", None), ("a", "f")], "path string, name string")
    got = {r.name: (round(r.crap, 6), r.model) for r in metrics.crap_or_estimate(f, measured, reach).collect()}
    score = lambda share: round(25 * (1 - share) ** 3 + 5, 6)
    assert got == {"f": (score(0.85), "estimated"), "g": (score(0.4), "estimated"), "h": (30.0, "estimated"), "m": (score(0.5), "measured"), "z": (score(0.4), "estimated")}


def test_routes(spark):
    """The reviewer by address, handle and hidden address; a declared owner, bots, ties, and files with no one to ask."""
    who = {"a": "x@m y@m y@m z@m w@m", "b": "me@work", "c": "ci-bot@m bot@m", "d": "1+me@users.noreply.host y@m", "e": "y@m", "f": "y@m", "g": "bot@m", "h": "ME@other z@m"}
    changes = [(p, a) for p, v in who.items() for a in v.split()] + [(None, "x"), ("a", None)]
    declared = spark.createDataFrame([("e", "@team"), ("f", "@ME"), ("g", "@team"), ("a", None)], "path string, owner string")
    got = metrics.review_routes(spark.createDataFrame(changes, "path string, author string"), declared, ["me", "me@work"], ["*bot"])
    assert {r.path: (r.experts, r.bus_factor_one) for r in got.collect()} == {"a": (["y@m", "w@m", "x@m"], False), "d": (["y@m"], True), "e": (["@team"], True), "h": (["z@m"], True)}
    assert metrics.review_routes(spark.createDataFrame(changes[:1], "path string, author string"), declared, [], []).count() == 1


def test_groups_stay_whole(spark):
    rows = [(1, "a", 1, 9), (1, "b", 100, 300), (2, "a", 10, 12), (3, None, 1, 1), (4, "c", 1, 500), (5, "a", 5, 4)]
    instances = spark.createDataFrame(rows, "group long, path string, first long, last long")
    ranges = spark.createDataFrame([("b", 250, 250), ("a", 13, 20), ("c", 70, 71), (None, 1, 9)], "path string, first long, last long")
    assert sorted(r.group for r in findings.groups_in_diff(instances, ranges).collect()) == [1, 3, 4]


def test_boundaries(spark):
    edges = spark.createDataFrame([("a1", "b1", 1, False), ("a1", "b1", 1, False), ("a1", "b1", 2, True), ("a1", "b2", 3, None), ("a1", "c1", 4, True), ("a1", "a2", 5, False), ("a2", "b1", 6, False), ("n", "b1", 7, False), ("c1", "b1", 8, False), ("c1", "p", 9, False)], "src string, dst string, line int, type_only boolean")
    zones = spark.createDataFrame([(x, x[0]) for x in ("a1", "a2", "b1", "b2", "c1")] + [("p", "b")], "node string, zone string")
    allowed = spark.createDataFrame([("a", "b", True)], "zone_a string, zone_b string, type_only boolean")
    hidden = spark.createDataFrame([("a2", None), ("a1", 3)], "src string, line int")
    got = detectors.boundary_findings(edges, zones, allowed, spark.createDataFrame([("p",)], "node string"), hidden)
    assert sorted(tuple(r) for r in got.collect()) == [("a1", "b1", 1, "a", "b"), ("a1", "c1", 4, "a", "c"), ("c1", "b1", 8, "c", "b")]


def test_running_sum(spark):
    """One key with a third of the rows, ties, nulls in the order and in the values; many ranges."""
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.4 else r.choice(["a", "z", None]), r.choice([None, *range(400)]), r.choice([None, *range(9)])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "path string, fn long, n long")
    place = lambda x: ((x[0] is not None, x[0] or ""), (x[1] is not None, x[1] or 0))
    sums, total = {}, 0
    for x in sorted(rows, key=place):
        total += x[2] or 0
        sums[place(x)] = total
    got = extensions.running_sum(df, ["path", "fn"], F.col("n"), "so_far").collect()
    assert len(got) == len(rows) and all(x.so_far == sums[place(x)] for x in got)
    assert extensions.running_sum(df.limit(0), ["path", "fn"], F.col("n"), "so_far").count() == 0


def test_constant_parameters(spark):
    """Kinds of values, calls of itself, keys of objects that are omitted or unknown, and a function called once."""
    params = [("f", 0, None, True), ("f", 1, None, False), ("f", 2, "k", True), ("f", 2, "m", True), ("g", 0, None, True), ("g", 1, "k", False), ("h", 0, None, True), ("i", 0, None, True), ("i", 0, None, None)]
    calls = [("f", "1"), ("f", "2"), ("f", "2"), ("f", "3"), ("g", "4"), ("g", "5"), ("h", "6"), (None, "7")]
    args = [
        ("1", 0, None, "literal", "1"), ("2", 0, None, "literal", "1"), ("3", 0, None, "same", None), ("2", 1, None, "unknown", None),
        ("1", 2, None, "object", None), ("1", 2, "k", "binding", "K"), ("2", 2, None, "object", None), ("2", 2, "k", "binding", "K"), ("3", 2, None, "object", None), ("3", 2, "k", "binding", "K"),
        ("4", 0, None, "literal", "1"), ("5", 0, None, "string", "1"), ("4", 1, None, "undefined", None), ("6", 0, None, "literal", "1"),
    ]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    p, c = frame(params, "fn string, index int, key string, optional boolean"), frame(calls, "fn string, call string")
    got = detectors.constant_parameters(p, c, frame(args, "call string, index int, key string, kind string, value string"))
    assert {(r.fn, r["index"], r.key): (r.reason, r.value, r.calls) for r in got.collect()} == {("f", 0, None): ("identical-argument", "1", 2), ("f", 2, "k"): ("identical-argument", "K", 3), ("f", 2, "m"): ("never-passed", None, 3)}


def test_imports_of_query_documents(spark):
    text = "#import './a.graphql'\n  \t#  import \t\"../b c.gql\"  # more\r\n# import 'pkg/c.graphql'\n#imports './no'\n#import'./no'\t\n#import './open\n#import \"./it's.gql\"\nimport './no'\n# see #import './no'\n#import ''\n#import './a.graphql'\n#import './x\"\n#"
    files = spark.createDataFrame([("q", text), ("n", None), ("e", "")], "path string, content string")
    assert sorted(r.source for r in markup.query_imports(files).collect()) == ["../b c.gql", "./a.graphql", "./it's.gql"]
