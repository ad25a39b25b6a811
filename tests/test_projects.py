"""Manifests with comments, workspaces, growing histories, caches, snapshots and markup facts on small inputs."""

from tessera.sources import markup, projects


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_json_with_comments(spark):
    text = '{ // one\n "a": "x // no", /* two */ "b": [1, 2,], "c": "y,]",}'
    got = files(spark, ("a.jsonc", text), ("b.jsonc", None)).select(projects.plain_json("content").alias("j")).selectExpr("from_json(j, 'a string, b array<int>, c string') AS j").select("j.*")
    assert rows(got) == [("x // no", [1, 2], "y,]"), (None, None, None)]


def test_key_values(spark):
    text = 'name = "x" # note\n[deps]\n"a-b" = \'1 # 2\'\n[[bin]]\npath = main\n# c = 1\n'
    assert rows(projects.key_values(files(spark, ("a.toml", text)))) == [("a.toml", "", "name", "x"), ("a.toml", "bin", "path", "main"), ("a.toml", "deps", "a-b", "1 # 2")]


def test_indented_values(spark):
    text = "packages:\n  - 'apps/*'\n  - libs/*  # all\ncatalogs:\n  react:\n    dom: ^18\nflag: true\n"
    got = rows(projects.indented_values(files(spark, ("w.yaml", text))))
    assert got == [("w.yaml", "catalogs.react.dom", "^18"), ("w.yaml", "flag", "true"), ("w.yaml", "packages", "apps/*"), ("w.yaml", "packages", "libs/*")]


def test_deno_imports(spark):
    text = '{ "imports": { "a": "npm:@x/y@^1/sub", "b": "jsr:@std/fs@1", "c": "./c.ts", }, }'
    assert {(r.name, r.package) for r in projects.deno_imports(files(spark, ("deno.json", text))).collect()} == {("a", "@x/y"), ("b", "@std/fs"), ("c", None)}


def test_workspaces(spark):
    manifests = spark.createDataFrame([(p,) for p in ("package.json", "apps/a/package.json", "apps/old/package.json", "libs/deep/b/package.json")], "path string")
    declared, missing = projects.workspaces(manifests, ["apps/*", "!apps/old", "tools/*"])
    assert {tuple(r) for r in declared.collect()} == {("apps/a", True), ("apps/old", False), ("libs/deep/b", False)}
    assert rows(missing) == [("tools/*",)]
    deps = spark.createDataFrame([("apps/a", "b", "workspace:*"), ("apps/a", "c", "link:../../libs/c"), ("apps/a", "d", "1")], "workspace string, name string, version string")
    own = spark.createDataFrame([("b", "libs/deep/b")], "name string, root string")
    assert rows(projects.linked_dependencies(deps, own)) == [("apps/a", "b", "libs/deep/b"), ("apps/a", "c", "libs/c")]


def test_histories(spark):
    kind = "commit string, path string"
    got = projects.extended_history(spark.createDataFrame([("1", "a"), ("2", "b")], kind), spark.createDataFrame([("2", "b"), ("3", "c")], kind))
    assert rows(got) == [("1", "a"), ("2", "b"), ("3", "c")]
    events = ['{"commit":"1","path":"a","timestamp":5,"author":"x","added":2}', '{"path":"a","timestamp":5}', "no json", '{"commit":"1","path":"a","timestamp":5,"added":-1}']
    good, bad = projects.imported_history(spark.createDataFrame([(e,) for e in events], "value string"))
    assert [(r.commit, r.added, r.deleted, r.ts.timestamp()) for r in good.collect()] == [("1", 2, 0, 5.0)]
    assert sorted(r.reason for r in bad.collect()) == ["negative count", "no commit", "no commit"]


def test_fact_cache_scans_each_content_once(spark, tmp_path):
    seen = []

    def scan(some):
        seen.append(some.count())
        return some.selectExpr("path AS file", "length(content) AS n").filter("n > 0")

    cache = projects.FactCache(spark, str(tmp_path), "v1")
    assert cache.load() is None
    one = files(spark, ("a", "xx"), ("b", "xx"), ("c", ""))
    assert rows(cache.facts(one, scan)) == [("a", 2), ("b", 2)]
    assert rows(cache.facts(one.union(files(spark, ("d", "yyy"))), scan)) == [("a", 2), ("b", 2), ("d", 3)]
    assert seen == [2, 1]


def test_snapshots_and_reports(spark, tmp_path):
    signs = spark.createDataFrame([(1, 2.5)], "functions long, score double")
    for run, day in (("r1", "2024-01-01"), ("r2", "2024-01-02")):
        projects.save_snapshot(signs, str(tmp_path / "s"), run, day, 1)
    assert {(r.metric, r.value, r.run) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(m, v, r) for m, v in (("functions", 1.0), ("score", 2.5)) for r in ("r1", "r2")}
    reports = spark.createDataFrame([('{"findings":[{"rule":"r","path":"a","line":3,"message":"m"}]}',), ("broken",)], "value string")
    assert rows(projects.saved_report(reports)) == [("r", "a", 3, "m")]


def test_map_payload(spark):
    f = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "path string, size int")
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    got = {r.part: r.json for r in projects.map_payload(f, e, spark.createDataFrame([("a>b",)], "cycle string"), 2).collect()}
    assert got == {"files": '[{"path":"a","size":3},{"path":"b","size":2}]', "edges": '[{"src":"a","dst":"b"}]', "cycles": '[{"cycle":"a>b"}]'}


def test_markup_facts(spark):
    gts = "import A from 'a';\n<template><A.B @x={{1}} /><p>import z</p></template>\nconst c = 1;"
    f = files(spark, ("a.gts", gts))
    assert rows(markup.template_components(f)) == [("a.gts", "A.B")]
    bare = f.select(markup.without_templates(f.content).alias("c")).first()["c"]
    assert len(bare) == len(gts) and "import z" not in bare and bare.endswith("const c = 1;")
    assert rows(markup.query_imports(files(spark, ("q.graphql", "#import './a.graphql'\n# other\nquery { x }")))) == [("q.graphql", "./a.graphql")]
    sheet = "@import 'x.css'; /* url(no.png) */ .a { composes: b c from './b.css'; composes: d; background: url(\"i.png\") }"
    got = {tuple(r)[1:] for r in markup.sheet_references(files(spark, ("a.css", sheet))).collect()}
    assert got == {("import", None, "x.css"), ("composes", "b", "./b.css"), ("composes", "c", "./b.css"), ("composes", "d", None), ("url", None, "i.png")}
    script = "x.classList.add('a', \"b-c\"); y.classList.toggle(name); z.className = 'd e';"
    assert {(r.name, r.dynamic) for r in markup.script_classes(files(spark, ("a.js", script))).collect()} == {(n, True) for n in ("a", "b-c", "d", "e")}
    assert [r.sheet for r in markup.styles_in_script(files(spark, ("a.js", "const A = styled.div`color: red;`; css`b`"))).collect()] == ["color: red;", "b"]
