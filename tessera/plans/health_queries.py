"""Queries of health scores on the driver's tables, with their SQL: orders are functions, customers files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health
from ..sources.facts import EXPORTS_SQL, REFS_SQL, exports, refs
from .registry import query

FN_SQL = "fns AS (SELECT l_orderkey AS fn, l_suppkey AS file, l_linenumber + l_quantity::BIGINT // 5 AS cyclomatic, l_quantity::BIGINT * 2 AS lines, l_linenumber = 7 AS synthetic FROM lineitem)"


def fns(t):
    return t("lineitem").selectExpr("l_orderkey AS fn", "l_suppkey AS file", "cast(l_linenumber + cast(l_quantity AS long) div 5 AS long) AS cyclomatic", "cast(l_quantity AS long) * 2 AS lines", "l_linenumber = 7 AS synthetic")


@query("""WITH f AS (SELECT o_orderkey AS fn, 1 + o_orderkey % 9 AS cyclomatic FROM orders), c AS (SELECT l_orderkey AS fn, sum(l_linenumber)::BIGINT AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), g AS (SELECT fn, cyclomatic AS standard, greatest(1, cyclomatic - coalesce(w, 0)) AS cyclomatic FROM f LEFT JOIN c USING (fn))
  SELECT fn, cyclomatic, CASE WHEN cyclomatic <> standard THEN standard ELSE 0 END AS standard FROM g""")
def gated_cyclomatic(t, spark, d):
    f = t("orders").selectExpr("o_orderkey AS fn", "1 + o_orderkey % 9 AS cyclomatic")
    parts = t("lineitem").selectExpr("l_orderkey AS fn", "l_linenumber AS weight", "l_returnflag = 'R' AS membership")
    return health.gated_cyclomatic(f, parts, "literal-membership").fillna(0, ["standard"])


@query("""SELECT name, row_number() OVER (ORDER BY priority DESC, severity DESC, has_crap DESC, cyclomatic DESC, cognitive DESC, lines DESC, path, line, col, name) AS place
  FROM (SELECT o_orderkey AS name, o_orderpriority AS priority, o_orderstatus AS severity, o_totalprice > 250000 AS has_crap, o_custkey % 10 AS cyclomatic, o_custkey % 7 AS cognitive, o_custkey % 3 AS lines, o_custkey AS path, o_orderdate AS line, 0 AS col FROM orders) ORDER BY place LIMIT 50""")
def ordered_findings(t, spark, d):
    f = t("orders").selectExpr("o_orderkey AS name", "o_orderpriority AS priority", "o_orderstatus AS severity", "o_totalprice > 250000 AS has_crap", "o_custkey % 10 AS cyclomatic", "o_custkey % 7 AS cognitive", "o_custkey % 3 AS lines", "o_custkey AS path", "o_orderdate AS line", "0 AS col")
    top = f.orderBy(*health.finding_order()).limit(50)  # a report of the first 50
    from pyspark.sql.window import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(*health.finding_order())).cast("long")).select("name", "place")


@query("WITH " + FN_SQL + """, p AS (SELECT file, count(*) AS functions, sum(cyclomatic)::BIGINT AS cyclomatic, max(cyclomatic) AS worst, sum(lines) AS lines FROM fns GROUP BY 1), c AS (SELECT user_id AS file, count(*) AS commits FROM events GROUP BY 1)
  SELECT file, functions, cyclomatic, worst, coalesce(commits, 0) AS commits, round(greatest(0.0, least(100.0, 100 - 2 * (cyclomatic / functions - 1) - lines / functions / 10)), 1) AS maintainability FROM p LEFT JOIN c USING (file)""")
def file_scores(t, spark, d):
    return health.file_scores(fns(t), t("events").select(F.col("user_id").alias("file")))


@query("SELECT doc_id AS file, n AS lines, n - 12 AS over FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) WHERE n > 12")
def long_files(t, spark, d):
    lines = t("documents").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))
    return health.long_files(lines, 12)


@query("WITH " + FN_SQL + " SELECT fn, lines FROM fns WHERE NOT synthetic AND lines > 90 AND (SELECT 100 * avg((lines > 80)::INT) FROM fns WHERE NOT synthetic) >= 3")
def large_functions(t, spark, d):
    return health.large_functions(fns(t), 90, 80)


@query("""SELECT component, sum(a)::BIGINT AS class_complexity, sum(b)::BIGINT AS template_complexity, sum(a + b)::BIGINT AS total FROM (SELECT o_custkey AS component, o_orderkey % 5 AS a, 0 AS b FROM orders UNION ALL SELECT user_id, 0, event_id % 3 FROM events) GROUP BY 1""")
def component_rollup(t, spark, d):
    return health.component_rollup(t("orders").selectExpr("o_custkey AS component", "o_orderkey % 5 AS complexity"), t("events").selectExpr("user_id AS component", "event_id % 3 AS complexity"))


SIGNS_SQL = "WITH " + FN_SQL + """, s AS (SELECT %s count(*) AS functions, quantile_disc(cyclomatic, 0.5) AS p50, quantile_disc(cyclomatic, 0.9) AS p90, round(100 * avg((cyclomatic > 10)::INT), 1) AS complex_percent, round(100 * avg((lines > 60)::INT), 1) AS long_percent FROM fns %s)"""


@query(SIGNS_SQL % ("", "") + " SELECT * FROM s")
def vital_signs(t, spark, d):
    return health.vital_signs(fns(t))


@query(SIGNS_SQL % ("s_nationkey AS \"group\",", "JOIN supplier ON file = s_suppkey GROUP BY 1") + """, x AS (SELECT *, round(greatest(0, 100 - 0.3 * complex_percent), 1) AS score FROM s)
  SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM x""")
def health_by_group(t, spark, d):
    own = fns(t).join(t("supplier"), F.col("file") == F.col("s_suppkey")).withColumnRenamed("s_nationkey", "group")
    return health.health_score(health.vital_signs(own, ["group"]))


@query("""SELECT o_orderpriority AS component, o_orderstatus AS path, count(DISTINCT o_custkey) AS parents, count(*) AS sites FROM orders GROUP BY 1, 2 ORDER BY parents DESC, sites DESC, path, component LIMIT 10""")
def most_rendered(t, spark, d):
    return health.most_rendered(t("orders").selectExpr("o_orderpriority AS component", "o_orderstatus AS path", "o_custkey AS parent"), 10)


@query("""WITH s AS (SELECT l_shipdate::DATE AS day_, l_returnflag AS metric, count(*) AS value, year(l_shipdate) AS version FROM lineitem GROUP BY ALL), p AS (SELECT *, lag(value) OVER w AS previous, lag(version) OVER w AS had FROM s WINDOW w AS (PARTITION BY metric ORDER BY day_))
  SELECT strftime(day_, '%Y-%m-%d') AS run, metric, previous, value, value - previous AS delta, CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'flat' END AS direction FROM p WHERE had = version""")
def health_trends(t, spark, d):
    day = F.to_date("l_shipdate")
    s = t("lineitem").groupBy(day.alias("at"), F.col("l_returnflag").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return health.trends(s.select(F.date_format("at", "yyyy-MM-dd").alias("run"), "at", "metric", "value", F.year("at").alias("version")))


@query("WITH " + EXPORTS_SQL + ", " + REFS_SQL + """ SELECT 'file' AS kind, c_custkey::VARCHAR AS key FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
  UNION ALL SELECT 'export', export::VARCHAR FROM exports WHERE NOT is_type AND export NOT IN (SELECT export FROM refs WHERE is_value) AND export NOT IN (SELECT item_id FROM benchmark)""")
def coverage_gaps(t, spark, d):
    file = lambda table, c: t(table).select(F.col(c).alias("file"))
    return health.coverage_gaps(file("customer", "c_custkey"), exports(t), file("events", "user_id"), refs(t).filter("is_value"), t("benchmark").select(F.col("item_id").alias("export")))


@query("""WITH c AS (SELECT l_orderkey AS commit_, count(DISTINCT l_partkey) AS files, sum(l_linenumber) AS lines FROM lineitem GROUP BY 1)
  SELECT file, median(files) AS files, median(lines) AS lines FROM (SELECT DISTINCT l_orderkey AS commit_, l_partkey AS file FROM lineitem) JOIN c USING (commit_) GROUP BY 1""")
def change_dispersion(t, spark, d):
    return health.change_dispersion(t("lineitem").selectExpr("l_orderkey AS commit", "l_partkey AS file", "l_linenumber AS lines"))


@query("""WITH a AS (SELECT DISTINCT user_id AS file FROM events WHERE event_type = 'error' AND value > 150), b AS (SELECT DISTINCT o_custkey AS file FROM orders WHERE o_totalprice > 300000)
  SELECT c_nationkey AS "group", count(*) FILTER (c_custkey IN (SELECT file FROM a)) AS direct, count(*) FILTER (c_custkey NOT IN (SELECT file FROM a)) AS reached FROM customer WHERE c_custkey IN (SELECT file FROM a UNION SELECT file FROM b) GROUP BY 1""")
def owner_group_reach(t, spark, d):
    changed = t("events").filter("event_type = 'error' AND value > 150").select(F.col("user_id").alias("file"))
    closure = t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("file"))
    return health.owner_reach(changed, closure, t("customer").selectExpr("c_custkey AS file", "c_nationkey AS group"))


@query("""WITH s AS (SELECT c_custkey AS key, c_acctbal > 5000 AS used, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS hits, c_nationkey < 10 AS tested, c_mktsegment = 'BUILDING' AS complex FROM customer),
  v AS (SELECT key, CASE WHEN hits > 0 AND NOT tested AND complex THEN 'at-risk' WHEN hits > 0 AND NOT tested THEN 'gap' WHEN hits > 0 THEN 'healthy' WHEN NOT used THEN 'dead' WHEN tested THEN 'idle' ELSE 'unproven' END AS verdict FROM s)
  SELECT *, CASE WHEN verdict IN ('at-risk', 'gap') THEN 'add-tests' WHEN verdict = 'dead' THEN 'remove' WHEN verdict IN ('idle', 'unproven') THEN 'review' ELSE 'keep' END AS action FROM v""")
def coverage_verdicts(t, spark, d):
    hits = t("events").groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("hits"))
    s = t("customer").selectExpr("c_custkey AS key", "c_acctbal > 5000 AS used", "c_nationkey < 10 AS tested", "c_mktsegment = 'BUILDING' AS complex")
    return health.coverage_verdicts(s.join(hits, "key", "left"))


@query("""SELECT o_orderkey AS key, o_custkey AS file, o_totalprice AS hits FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND o_custkey IN (SELECT user_id FROM events) ORDER BY hits DESC, key LIMIT 25""")
def runtime_rows(t, spark, d):
    rows = t("orders").selectExpr("o_orderkey AS key", "o_custkey AS file", "o_totalprice AS hits")
    return health.runtime_rows(rows, t("lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("key")), t("events").select(F.col("user_id").alias("file")), 25)


@query("""SELECT p_brand AS detector, CASE WHEN count(n_name) > 0 THEN 'active' ELSE 'no-package' END AS status, count(n_name) AS packages FROM (SELECT DISTINCT p_brand, p_size FROM part) LEFT JOIN (SELECT DISTINCT n_nationkey AS p_size, n_name FROM nation WHERE n_regionkey = 1) USING (p_size) GROUP BY 1""")
def detector_availability(t, spark, d):
    have = t("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("package"))
    return health.detector_availability(t("part").selectExpr("p_brand AS detector", "p_size AS package"), have)
