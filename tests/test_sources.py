"""Facts of source files, manifests, history and coverage."""

from tessera.sources import code


def files(spark, *rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_facts(spark):
    text = """
import React, { useState } from 'react'; import type { A } from "./a"; import './side.css';
// import { no } from 'comment'
/* export const no = 1 */
const u = "http://x"; const m = require('fs'); const l = import('./lazy');
export const one = 1; export default function two() {}
export { u as three, m }; export * from './all'; export { x as y } from './some';
"""
    got = {(r.kind, r.name, r.source) for r in code.facts(files(spark, ("a.ts", text), ("b.ts", None), ("c.ts", ""))).collect()}
    assert got == {
        ("import", "React, { useState }", "react"), ("type_import", "{ A }", "./a"), ("side_effect", None, "./side.css"), ("require", None, "fs"),
        ("dynamic_import", None, "./lazy"), ("export", "one", None), ("export", "default", None), ("export", "three", None), ("export", "m", None),
        ("re_export", "*", "./all"), ("re_export", "{ x as y }", "./some"),
    }


def test_component_files_give_their_scripts_only(spark):
    text = "<template>import x from 'no'</template>\n<script setup>import y from 'yes'</script>"
    assert [(r.name, r.source) for r in code.facts(files(spark, ("a.vue", text))).collect()] == [("y", "yes")]
    assert [r.source for r in code.facts(files(spark, ("a.astro", "---\nimport z from 'front'\n---\n<p>import q from 'no'</p>"))).collect()] == ["front"]


def test_branching_leaves_out_strings_and_comments(spark):
    rows = code.branching(files(spark, ("a.js", "if (a && b) { x ? 1 : 2 } // if\nlet s = 'if || for';\n"), ("b.js", None))).collect()
    assert {(r.file, r.lines, r.branches) for r in rows} == {("a.js", 2, 3), ("b.js", 0, 0)}


def test_markers(spark):
    text = "a\n// lint-ignore-next-line one, two\nb\n// lint-ignore-next-line\nc"
    assert {tuple(r) for r in code.markers(files(spark, ("a.ts", text)), "lint").collect()} == {("a.ts", 3, "one"), ("a.ts", 3, "two"), ("a.ts", 5, None)}


def test_manifests(spark):
    text = '{"name": "x", "dependencies": {"a": "1"}, "devDependencies": {"b": "^2"}}'
    got = {tuple(r) for r in code.manifest_dependencies(files(spark, ("package.json", text), ("bad/package.json", "{"), ("empty/package.json", "{}"))).collect()}
    assert got == {("package.json", "prod", "a", "1"), ("package.json", "dev", "b", "^2")}


def test_history(spark):
    log = "--abcdef1|1700000000|Ann\n\n3\t1\tsrc/a.ts\n-\t-\tlogo.png\n--abcdef2|1700000100|Bo|b\n1\t0\tsrc/a.ts\n"
    got = code.history(spark.createDataFrame([(log,)], "value string")).collect()
    assert [(r.commit, r.author, r.path, r.added, r.deleted) for r in got] == [("abcdef1", "Ann", "src/a.ts", 3, 1), ("abcdef1", "Ann", "logo.png", 0, 0), ("abcdef2", "Bo|b", "src/a.ts", 1, 0)]
    assert got[0].ts.timestamp() == 1700000000


def test_coverage(spark):
    got = code.coverage(spark.createDataFrame([('{"a.ts": {"s": {"0": 1, "1": 0}}, "b.ts": {"s": {}}}',)], "value string"))
    assert {tuple(r) for r in got.collect()} == {("a.ts", 2, 1), ("b.ts", 0, 0)}


def test_discover(spark, tmp_path):
    for name in ("src/a.ts", "src/gen/b.ts", "c.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("export const x = 1")
    got = code.discover(spark, str(tmp_path), ["ts", "js"], ["src/gen/*"])
    assert [tuple(r) for r in got.collect()] == [("src/a.ts", "export const x = 1")]
