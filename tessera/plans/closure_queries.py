"""Queries of closures, cycles and traces over all events, with customers as files, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dead_code, graphs, security
from ..sources.facts import EXPORTS_SQL, PAIRS_SQL, REFS_SQL, exports, pairs, refs
from .registry import query

EDGES_SQL = PAIRS_SQL + ", e AS (SELECT DISTINCT owner AS src, name AS dst, kind FROM pairs)"


def edges(t, *kinds):
    return pairs(t, *kinds).select(F.col("owner").alias("src"), F.col("name").alias("dst"), "kind")


@query("""WITH e AS (SELECT user_id AS src, json_extract_string(props, '$.k')::BIGINT AS dst, event_type AS kind, value < 60 AS type_only FROM events UNION ALL SELECT o_custkey, o_custkey % 100, 'require', false FROM orders)
  SELECT src, dst, bool_and(type_only) AS type_only, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM e GROUP BY 1, 2""")
def graph_build(t, spark, d):
    a = t("events").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), F.col("event_type").alias("kind"), (F.col("value") < 60).alias("type_only"))
    return graphs.build_graph(a, t("orders").selectExpr("o_custkey AS src", "o_custkey % 100 AS dst", "'require' AS kind", "false AS type_only"))


@query("WITH RECURSIVE " + EDGES_SQL + """, a AS (SELECT 149::BIGINT AS node UNION SELECT dst FROM a JOIN e ON node = src WHERE kind <> 'error'), b AS (SELECT 148::BIGINT AS node UNION SELECT dst FROM b JOIN e ON node = src WHERE kind = 'view')
  SELECT node, (CASE WHEN node IN (SELECT node FROM a) THEN 1 ELSE 0 END + CASE WHEN node IN (SELECT node FROM b) THEN 2 ELSE 0 END)::BIGINT AS bits FROM (SELECT node FROM a UNION SELECT node FROM b)""")
def typed_roots(t, spark, d):
    mask = F.when(F.col("kind") == "view", 3).when(F.col("kind") == "error", 0).otherwise(1).cast("long")
    roots = spark.createDataFrame([(149, 1), (148, 2)], "node long, bits long")
    return graphs.reach_bits(edges(t).select("src", "dst", mask.alias("mask")), roots)


@query("WITH " + EDGES_SQL + """, i AS (SELECT dst AS node, count(DISTINCT src) AS n FROM e WHERE src <> dst GROUP BY 1), o AS (SELECT src AS node, count(DISTINCT dst) AS n FROM e WHERE src <> dst GROUP BY 1)
  SELECT c_custkey AS node, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, c_custkey IN (SELECT dst FROM e WHERE kind = 'error') AS dynamic, c_custkey IN (SELECT dst FROM e WHERE kind = 'view') AS re_exported
  FROM customer LEFT JOIN i ON i.node = c_custkey LEFT JOIN o ON o.node = c_custkey""")
def focus_facts(t, spark, d):
    kind = F.when(F.col("kind") == "error", "dynamic").when(F.col("kind") == "view", "re-export").otherwise("static").alias("kind")
    return graphs.focus_facts(edges(t).select("src", "dst", kind), t("customer").select(F.col("c_custkey").alias("node")))


@query("WITH RECURSIVE " + EDGES_SQL + """, s AS (SELECT src, dst FROM e GROUP BY 1, 2 HAVING bool_or(kind = 'click')), l AS (SELECT 140::BIGINT AS node, '140' AS path, [140::BIGINT] AS p, 0 AS n UNION ALL
  SELECT s.dst, l.path || '>' || s.dst, list_append(p, s.dst), n + 1 FROM l JOIN s ON node = src WHERE n < 3) SELECT node, arg_min(path, p) AS path FROM l JOIN (SELECT node, min(n) AS n FROM l GROUP BY 1) USING (node, n) GROUP BY 1""")
def eager_paths(t, spark, d):
    e = edges(t).select("src", "dst", F.when(F.col("kind") == "click", "static").otherwise("dynamic").alias("kind"), F.lit(False).alias("type_only"))
    found = graphs.eager_paths(e, 140)
    return found.filter(F.size(F.split("path", ">")) <= 4)


@query("WITH RECURSIVE " + EDGES_SQL + """, s AS (SELECT DISTINCT src, dst FROM e WHERE kind <> 'error' AND kind <> 'view' AND src <> dst), p AS (SELECT [src, dst] AS path FROM s WHERE src < dst
  UNION ALL SELECT list_append(path, dst) FROM p JOIN s ON path[len(path)] = src WHERE len(path) < 3 AND dst > path[1] AND NOT list_contains(path, dst)), c AS (SELECT array_to_string(path, '>') AS cycle, len(path) AS hops FROM p JOIN s ON path[len(path)] = src AND path[1] = dst)
  SELECT * FROM c WHERE NOT (hops = 2 AND starts_with(cycle, '0>'))""")
def eager_cycles(t, spark, d):
    kind = F.when(F.col("kind").isin("error", "view"), "dynamic").otherwise("static").alias("kind")
    accepted = spark.range(1, 100).select(F.concat(F.lit("0|"), F.col("id")).alias("key"))
    return graphs.eager_cycles(edges(t).select("src", "dst", kind), 3, accepted)


@query("WITH RECURSIVE " + EDGES_SQL + """, s AS (SELECT src, dst FROM e WHERE kind = 'click' AND src <> dst), r AS (SELECT src, dst FROM s UNION SELECT r.src, s.dst FROM r JOIN s ON r.dst = s.src), k AS (SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1 HAVING count(DISTINCT a.dst) > 1),
  p AS (SELECT [src, dst] AS path FROM s WHERE src < dst UNION ALL SELECT list_append(path, dst) FROM p JOIN s ON path[len(path)] = src WHERE len(path) < 3 AND dst > path[1] AND NOT list_contains(path, dst)),
  c AS (SELECT array_to_string(path, '>') AS cycle, len(path) AS hops, path[1] AS node FROM p JOIN s ON path[len(path)] = src AND path[1] = dst), n AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY hops, cycle) AS r, count(*) OVER (PARTITION BY component) AS n FROM c JOIN k USING (node))
  SELECT cycle, hops, n > 25 AS truncated FROM n WHERE r <= 25""")
def capped_cycles(t, spark, d):
    return graphs.elementary_cycles(edges(t, "click"), 3, cap=25)


@query("WITH RECURSIVE " + EDGES_SQL + """, s AS (SELECT src, dst FROM e WHERE kind = 'click' AND src <> dst), r AS (SELECT src, dst FROM s UNION SELECT r.src, s.dst FROM r JOIN s ON r.dst = s.src), k AS (SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1 HAVING count(DISTINCT a.dst) > 1),
  p AS (SELECT [src, dst] AS path FROM s WHERE src < dst UNION ALL SELECT list_append(path, dst) FROM p JOIN s ON path[len(path)] = src WHERE len(path) < 3 AND dst > path[1] AND NOT list_contains(path, dst)),
  c AS (SELECT path, array_to_string(path, '>') AS cycle, path[1] AS node FROM p JOIN s ON path[len(path)] = src AND path[1] = dst),
  a AS (SELECT o_orderkey AS entry, CASE o_orderkey % 4 WHEN 0 THEN [o_custkey % 100, (o_custkey // 100) % 100] WHEN 1 THEN [o_custkey % 100, (o_custkey * 7) % 100, (o_custkey * 13 + 1) % 100] WHEN 2 THEN [o_custkey, 100000 + o_orderkey] ELSE [1::BIGINT, 2, 3, 4] END AS files FROM orders),
  b AS (SELECT *, array_to_string(list_concat(files[list_position(files, list_min(files)):], files[:list_position(files, list_min(files)) - 1]), '>') AS cycle FROM a),
  h AS (SELECT component FROM c JOIN k USING (node) WHERE len(path) = 2 AND cycle NOT IN (SELECT cycle FROM b) GROUP BY 1 HAVING count(*) > 25),
  l AS (SELECT * FROM c JOIN k USING (node) WHERE len(path) = 2 OR component NOT IN (SELECT component FROM h)), f AS (SELECT component FROM l WHERE cycle NOT IN (SELECT cycle FROM b) GROUP BY 1 HAVING count(*) > 25)
  SELECT entry, CASE WHEN cycle IN (SELECT cycle FROM l) THEN 'matched' WHEN len(files) > 3 OR (SELECT count(*) = len(files) AND min(component) = max(component) FROM unnest(files) u(n) JOIN k ON n = node WHERE component IN (SELECT component FROM f)) THEN 'unprovable' ELSE 'unmatched' END AS state FROM b""")
def cycle_entries(t, spark, d):
    o = t("orders")
    at = lambda *c: F.array(*[F.expr(x).cast("long") for x in c])
    kind = F.col("o_orderkey") % 4
    files = F.when(kind == 0, at("o_custkey % 100", "o_custkey div 100 % 100")).when(kind == 1, at("o_custkey % 100", "o_custkey * 7 % 100", "(o_custkey * 13 + 1) % 100"))
    files = files.when(kind == 2, at("o_custkey", "100000 + o_orderkey")).otherwise(at("1", "2", "3", "4"))
    return graphs.Cycles(edges(t, "click"), 3, cap=25, entries=o.select(F.col("o_orderkey").alias("entry"), files.alias("files"))).entry_states()


@query("WITH RECURSIVE " + EDGES_SQL + """, s AS (SELECT src, dst FROM e WHERE kind = 'view'), r AS (SELECT src, dst FROM s WHERE src <> dst UNION SELECT r.src, s.dst FROM r JOIN s ON r.dst = s.src AND s.src <> s.dst), k AS (SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1 HAVING count(DISTINCT a.dst) > 1),
  m AS (SELECT * FROM k UNION SELECT src, src FROM s WHERE src = dst AND src NOT IN (SELECT node FROM k)) SELECT * FROM m WHERE component NOT IN (SELECT component FROM m WHERE node IN (SELECT c_custkey FROM customer WHERE c_acctbal < -960))""")
def re_export_cycles(t, spark, d):
    return graphs.re_export_cycles(edges(t, "view").select("src", "dst"), t("customer").filter("c_acctbal < -960").select(F.col("c_custkey").alias("node")))


@query("WITH RECURSIVE " + EDGES_SQL + """, d AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('error', 'view') AND src <> dst AND (src > dst AND (src + dst) % 11 = 0 OR src + 2 = dst AND src % 5 < 3)),
  h AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal < -800 UNION SELECT src FROM h JOIN d ON dst = node), i AS (SELECT * FROM d WHERE src IN (SELECT node FROM h) AND dst IN (SELECT node FROM h)),
  r AS (SELECT src, dst FROM i UNION SELECT r.src, i.dst FROM r JOIN i ON r.dst = i.src), c AS (SELECT h.node, coalesce(min(b.src), h.node) AS component FROM h LEFT JOIN (SELECT a.src AS node, a.dst AS src FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src UNION SELECT node, node FROM h) b USING (node) GROUP BY h.node),
  q AS (SELECT DISTINCT a.component AS a, b.component AS b FROM i JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.component <> b.component),
  l AS (SELECT component, 0::BIGINT AS layer FROM c UNION SELECT q.a, layer + 1 FROM l JOIN q ON q.b = component), u AS (SELECT src AS x, dst AS y FROM i UNION SELECT dst, src FROM i), w AS (SELECT node, node AS slice FROM h UNION SELECT y, slice FROM w JOIN u ON x = node)
  SELECT min(slice) AS slice, (SELECT max(layer) FROM l WHERE l.component = c.component) AS layer, node FROM w JOIN c USING (node) GROUP BY node, component""")
def partition_order(t, spark, d):
    e = edges(t, "error", "view").filter("src <> dst AND (src > dst AND (src + dst) % 11 = 0 OR src + 2 = dst AND src % 5 < 3)")
    return graphs.partition_order(e, t("customer").filter("c_acctbal < -800").select(F.col("c_custkey").alias("node")))


@query("WITH RECURSIVE " + EDGES_SQL + """, n AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'click' OR kind = 'view' AND dst % 3 > 0), r AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 500 = 1 UNION SELECT dst FROM r JOIN n ON node = src) SELECT node FROM r""")
def updated_reach(t, spark, d):
    roots, e = t("customer").filter("c_custkey % 500 = 1").select(F.col("c_custkey").alias("node")), edges(t, "click", "view")
    after = e.filter("kind = 'click' OR dst % 3 > 0").select("src", "dst").distinct()
    before = e.filter("kind = 'view'").select("src", "dst").distinct()
    known = graphs.reach(before, roots).select("node")
    return graphs.update_reach(after, known, roots, after.join(before, ["src", "dst"], "left_anti"), before.join(after, ["src", "dst"], "left_anti"))


@query("WITH " + EDGES_SQL + """, s AS (SELECT src, dst, min(ts) AS span FROM (SELECT user_id AS src, json_extract_string(props, '$.k')::BIGINT AS dst, event_id AS ts FROM events) GROUP BY 1, 2), a AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'click'),
  c AS (SELECT x.src || '>' || x.dst AS cycle, x.src, x.dst FROM a x JOIN a y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst) SELECT cycle, src, dst, span FROM (SELECT * FROM c UNION ALL SELECT cycle, dst, src FROM c) JOIN s USING (src, dst)""")
def cycle_anchors(t, spark, d):
    cycles = graphs.elementary_cycles(edges(t, "click"), 2).select("cycle")
    spans = t("events").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), F.col("event_id").alias("span"))
    return graphs.hop_anchors(cycles, spans)


@query("WITH RECURSIVE " + EDGES_SQL + """, h AS (SELECT src AS class, dst AS base FROM e WHERE kind = 'error' AND src > dst), s AS (SELECT base, class, 1::BIGINT AS depth FROM h UNION SELECT s.base, h.class, depth + 1 FROM s JOIN h ON h.base = s.class WHERE depth < 100)
  SELECT base, class, min(depth) AS depth FROM s GROUP BY 1, 2""")
def subclass_index(t, spark, d):
    return dead_code.subclass_index(edges(t, "error").filter("src > dst").selectExpr("src AS class", "dst AS base"))


@query("WITH RECURSIVE " + EDGES_SQL + """, s AS (SELECT src, dst FROM e WHERE kind = 'purchase'), a AS (SELECT 42::BIGINT AS node, 0::BIGINT AS hops UNION SELECT dst, hops + 1 FROM a JOIN s ON node = src WHERE hops < 2), b AS (SELECT 42::BIGINT AS node, 0::BIGINT AS hops UNION SELECT src, hops + 1 FROM b JOIN s ON node = dst WHERE hops < 2)
  SELECT 'callee' AS direction, node, min(hops) AS hops FROM a GROUP BY node HAVING min(hops) > 0 UNION ALL SELECT 'caller', node, min(hops) FROM b GROUP BY node HAVING min(hops) > 0""")
def symbol_chains(t, spark, d):
    return graphs.symbol_chain(edges(t, "purchase"), 42, 2)


@query("""WITH u AS (SELECT p_brand AS package, p_type AS name, l_suppkey AS file FROM lineitem JOIN part ON l_partkey = p_partkey), w AS (SELECT s_suppkey AS file, s_nationkey AS importer FROM supplier WHERE s_acctbal > 5000)
  SELECT package, name, count(DISTINCT file) AS direct, (SELECT count(DISTINCT importer) FROM u x JOIN w USING (file) WHERE x.package = u.package AND x.name = u.name) AS wrapped FROM u GROUP BY 1, 2""")
def usage_traces(t, spark, d):
    u = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("p_brand AS package", "p_type AS name", "l_suppkey AS file")
    return graphs.usage_trace(u, t("supplier").filter("s_acctbal > 5000").selectExpr("s_suppkey AS file", "s_nationkey AS importer"))


@query("""SELECT p_partkey AS trace, p_size AS pos, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'src/' || p_type || '.ts' WHEN p_type = 'MEDIUM' THEN 'MEDIUM.ts' ELSE '-' END AS path,
  CASE WHEN p_type IN ('SMALL', 'LARGE', 'MEDIUM') THEN p_size ELSE 0 END::BIGINT AS line FROM part""")
def stack_frames(t, spark, d):
    frames = t("part").selectExpr("p_partkey AS trace", "p_size AS pos", "concat('    at f (/app/src/', p_type, '.ts:', p_size, ':7)') AS frame")
    files = spark.createDataFrame([("src/SMALL.ts",), ("SMALL.ts",), ("src/LARGE.ts",), ("MEDIUM.ts",)], "path string")
    return graphs.stack_frames(frames, files).select("trace", "pos", F.coalesce("path", F.lit("-")).alias("path"), F.coalesce("line", F.lit(0)).cast("long").alias("line"))


@query("""WITH a AS (SELECT user_id AS root, json_extract_string(props, '$.k') AS slot, CASE event_type WHEN 'click' THEN 'write' ELSE 'read' END AS op, event_id % 10 AS file FROM events), d AS (SELECT c_custkey AS root, c_nationkey % 10 AS file FROM customer)
  SELECT root, slot, count(*) FILTER (op = 'read') AS reads, count(*) FILTER (op = 'write') AS writes, count(DISTINCT a.file) AS files FROM a JOIN d USING (root) WHERE a.file <> d.file GROUP BY 1, 2 HAVING count(*) FILTER (op = 'write') > 0 ORDER BY writes DESC, root, slot LIMIT 20000""")
def shared_state(t, spark, d):
    a = t("events").select(F.col("user_id").alias("root"), F.get_json_object("props", "$.k").alias("slot"), F.when(F.col("event_type") == "click", "write").otherwise("read").alias("op"), (F.col("event_id") % 10).alias("file"))
    return graphs.shared_state(a, t("customer").selectExpr("c_custkey AS root", "c_nationkey % 10 AS file"))


@query("WITH " + EXPORTS_SQL + ", " + REFS_SQL + """, k AS (SELECT 'label' AS node, 'direct' AS reach UNION ALL SELECT 'user', 'transitive' UNION ALL SELECT 'system', 'mocked_only' UNION ALL SELECT 'src1', 'none' UNION ALL SELECT 'src2', 'direct'),
  b AS (SELECT export, min(CASE reach WHEN 'direct' THEN 0 WHEN 'transitive' THEN 1 WHEN 'mocked_only' THEN 2 END) AS r FROM refs JOIN k ON from_file = node WHERE is_value GROUP BY 1)
  SELECT export, CASE r WHEN 0 THEN 'direct' WHEN 1 THEN 'transitive' WHEN 2 THEN 'mocked_only' ELSE CASE WHEN file = 'src2' THEN 'none' ELSE 'none_file' END END AS reach FROM exports LEFT JOIN b USING (export)""")
def export_test_reach(t, spark, d):
    reached = spark.createDataFrame([("label", "direct"), ("user", "transitive"), ("system", "mocked_only"), ("src1", "none"), ("src2", "direct")], "node string, reach string")
    return graphs.export_test_reach(exports(t), refs(t), reached)


@query("WITH RECURSIVE " + EDGES_SQL + """, r AS (SELECT c_custkey AS root, c_custkey AS node FROM customer WHERE c_acctbal > 9700 UNION SELECT root, dst FROM r JOIN e ON node = src WHERE kind = 'view')
  SELECT root, node, o_orderpriority AS module FROM r JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')) ON o_custkey = node""")
def leak_roots(t, spark, d):
    files = t("customer").selectExpr("c_custkey AS file", "c_acctbal > 9700 AS client_root")
    imports = t("orders").selectExpr("o_custkey AS file", "o_orderpriority AS module")
    return security.leak_roots(files, imports, edges(t, "view"), ["1-URGENT", "5-LOW"])
