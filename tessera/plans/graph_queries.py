"""Graph queries on the calls of error events, with customers as files and nations as packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, security
from ..sources.tables import CALLS_SQL, calls
from .registry import query

KIND_SQL = "CASE WHEN (src + dst) % 3 = 0 THEN 'static' WHEN (src + dst) % 3 = 1 THEN 'dynamic' ELSE 'worker' END"


def kinds(e):
    k = (F.col("src") + F.col("dst")) % 3
    return e.withColumn("kind", F.when(k == 0, "static").when(k == 1, "dynamic").otherwise("worker"))


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def zones(t):
    return t("customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("owner"))


def sizes(t):
    return t("orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("size"))


@query("WITH RECURSIVE " + CALLS_SQL + """, r AS (SELECT 5::BIGINT AS node, 0::BIGINT AS depth UNION SELECT src, depth + 1 FROM r JOIN edges ON node = dst WHERE depth < 100)
  SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def impact_closure(t, spark, d):
    return graphs.impact_closure(calls(spark, d), nodes(spark, 5))


@query("WITH " + CALLS_SQL + """, z AS (SELECT c_custkey AS node, c_nationkey::BIGINT AS owner FROM customer)
  SELECT DISTINCT a.owner AS src, b.owner AS dst FROM edges JOIN z a ON src = a.node JOIN z b ON dst = b.node WHERE a.owner <> b.owner""")
def package_edges(t, spark, d):
    return graphs.lifted(calls(spark, d), zones(t))


@query("WITH RECURSIVE " + CALLS_SQL + """, p AS (SELECT DISTINCT a.c_nationkey::BIGINT AS src, b.c_nationkey::BIGINT AS dst FROM edges JOIN customer a ON src = a.c_custkey JOIN customer b ON dst = b.c_custkey WHERE a.c_nationkey <> b.c_nationkey),
  r AS (SELECT src, dst FROM p UNION SELECT r.src, p.dst FROM r JOIN p ON r.dst = p.src)
  SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1 HAVING count(DISTINCT a.dst) > 1""")
def package_cycles(t, spark, d):
    return graphs.strong_components(graphs.lifted(calls(spark, d), zones(t)))


@query("WITH RECURSIVE " + CALLS_SQL + """, e AS (SELECT * FROM edges WHERE src <> dst), p AS (SELECT [src, dst] AS path FROM e WHERE src < dst
  UNION ALL SELECT list_append(path, dst) FROM p JOIN e ON path[len(path)] = src WHERE len(path) < 4 AND dst > path[1] AND NOT list_contains(path, dst))
  SELECT array_to_string(path, '>') AS cycle, len(path) AS hops FROM p JOIN e ON path[len(path)] = src AND path[1] = dst WHERE NOT (len(path) = 2 AND path[1] = 0 AND path[2] < 100)""")
def elementary_cycles(t, spark, d):
    accepted = spark.range(1, 100).select(F.concat(F.lit("0|"), F.col("id")).alias("key"))
    return graphs.elementary_cycles(calls(spark, d), 4, accepted)


@query("WITH RECURSIVE " + CALLS_SQL + f""", e AS (SELECT *, {KIND_SQL} AS kind FROM edges),
  a AS (SELECT 3::BIGINT AS node UNION SELECT dst FROM a JOIN e ON node = src WHERE kind = 'static'), b AS (SELECT 3::BIGINT AS node UNION SELECT dst FROM b JOIN e ON node = src WHERE kind <> 'worker'),
  c AS (SELECT 3::BIGINT AS node UNION SELECT dst FROM c JOIN e ON node = src)
  SELECT node, CASE WHEN node IN (SELECT node FROM a) THEN 'eager' WHEN node IN (SELECT node FROM b) THEN 'deferred' ELSE 'worker' END AS phase FROM c""")
def load_closure(t, spark, d):
    return graphs.load_closure(kinds(calls(spark, d)), nodes(spark, 3))


@query("WITH RECURSIVE " + CALLS_SQL + f""", e AS (SELECT *, (src + dst) % 3 > 0 AS mocked FROM edges),
  a AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM a JOIN e ON node = src WHERE NOT mocked), b AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM b JOIN e ON node = src)
  SELECT c_custkey AS node, CASE WHEN c_custkey IN (SELECT dst FROM e WHERE src = 1 AND NOT mocked) THEN 'direct' WHEN c_custkey IN (SELECT node FROM a) THEN 'transitive'
  WHEN c_custkey IN (SELECT node FROM b) THEN 'mocked_only' ELSE 'none' END AS reach FROM customer WHERE c_custkey <> 1""")
def test_reach_classes(t, spark, d):
    e = calls(spark, d).withColumn("mocked", (F.col("src") + F.col("dst")) % 3 > 0)
    return graphs.test_reach(zones(t), e, nodes(spark, 1))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS src, 10000000 + o_orderkey AS dst FROM orders UNION SELECT 10000000 + l_orderkey, 20000000 + l_partkey FROM lineitem),
  r AS (SELECT 7::BIGINT AS node UNION SELECT dst FROM r JOIN e ON node = src), s AS (SELECT 20000000 + p_partkey AS node, p_size AS size FROM part),
  w AS (SELECT src AS u, dst AS v, 7::BIGINT AS node FROM e WHERE src IN (SELECT node FROM r) UNION SELECT u, v, e.dst FROM w JOIN e ON node = e.src AND NOT (e.src = u AND e.dst = v)),
  k AS (SELECT DISTINCT u, v FROM w), l AS (SELECT u AS src, v AS dst, (SELECT sum(size)::BIGINT FROM r JOIN s USING (node) WHERE node NOT IN (SELECT node FROM w WHERE w.u = k.u AND w.v = k.v)) AS bytes FROM k)
  SELECT * FROM l WHERE bytes > 0 ORDER BY bytes DESC, src, dst LIMIT 10""")
def dominating_imports(t, spark, d):
    e = t("orders").selectExpr("o_custkey AS src", "10000000 + o_orderkey AS dst").union(t("lineitem").selectExpr("10000000 + l_orderkey", "20000000 + l_partkey"))
    return graphs.dominating_imports(e, 7, t("part").selectExpr("20000000 + p_partkey AS node", "cast(p_size AS long) AS size"))


@query("WITH RECURSIVE " + CALLS_SQL + """, e AS (SELECT * FROM edges WHERE (src + dst) % 3 = 0 OR ((src + dst) % 3 = 1 AND dst % 2 = 0)), r AS (SELECT 3::BIGINT AS node UNION SELECT dst FROM r JOIN e ON node = src)
  SELECT dst AS peer, string_agg(DISTINCT src::VARCHAR, ',' ORDER BY src::VARCHAR) AS hosts FROM edges WHERE (src + dst) % 3 < 2 AND src IN (SELECT node FROM r) GROUP BY 1""")
def peer_closure(t, spark, d):
    e = kinds(calls(spark, d))
    listed = spark.range(0, 100, 2).toDF("node")
    return graphs.peer_closure(e.filter("kind = 'static'").drop("kind"), e.filter("kind = 'dynamic'").drop("kind"), listed, nodes(spark, 3))


@query("WITH RECURSIVE " + CALLS_SQL + """, x AS (SELECT dst AS file, (dst % 2) AS exported, src AS source, (src % 2) AS imported FROM edges WHERE src < dst),
  o AS (SELECT 0::BIGINT AS file, 0::BIGINT AS name UNION SELECT c_custkey, c_custkey % 2 FROM customer WHERE c_acctbal > 8000),
  s AS (SELECT * FROM (SELECT DISTINCT * FROM x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.file = x.file AND o.name = x.exported)) QUALIFY count(*) OVER (PARTITION BY file, exported) = 1),
  r AS (SELECT 0::BIGINT AS file, 0::BIGINT AS name UNION SELECT s.file, s.exported FROM r JOIN s ON s.source = r.file AND s.imported = r.name) SELECT file, name FROM r""")
def re_export_routes(t, spark, d):
    x = calls(spark, d).filter("src < dst").selectExpr("dst AS file", "dst % 2 AS exported", "src AS source", "src % 2 AS imported")
    own = t("customer").filter("c_acctbal > 8000").selectExpr("c_custkey AS file", "c_custkey % 2 AS name").union(spark.sql("SELECT 0L, 0L")).distinct()
    return graphs.re_export_routes(own, x, 0, 0)


@query("WITH RECURSIVE " + CALLS_SQL + """, f AS (SELECT * FROM edges WHERE src <> dst), r AS (SELECT s AS source, s AS node, 0::BIGINT AS hops FROM (VALUES (2::BIGINT), (7::BIGINT)) v(s) UNION SELECT source, dst, hops + 1 FROM r JOIN f ON node = src WHERE hops < 3)
  SELECT source, node AS sink, min(hops) AS hops, CASE WHEN min(hops) <= 1 THEN 'high' WHEN min(hops) = 2 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE node % 3 = 1 GROUP BY 1, 2""")
def tainted_sinks(t, spark, d):
    return security.tainted(calls(spark, d).filter("src <> dst"), nodes(spark, 2, 7), spark.range(1, 100, 3).toDF("node"))
