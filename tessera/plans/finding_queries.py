"""Queries of baselines, differences, suppression and reports: line items and orders stand for findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as P
from .registry import query

LEVEL_SQL = "CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END"


def level(c="l_quantity"):
    return F.when(F.col(c) > 40, "high").when(F.col(c) > 20, "medium").otherwise("low")


@query("""SELECT event_id, user_id AS path, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 1000 END AS line FROM events e WHERE
  (event_id % 5 <> 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND event_id % 1000 BETWEEN c_nationkey * 20 AND c_nationkey * 20 + 300))
  OR (event_id % 5 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id))""")
def diff_scope(t, spark, d):
    line = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 1000)
    ranges = t("customer").select(F.col("c_custkey").alias("path"), (F.col("c_nationkey") * 20).cast("long").alias("first"), (F.col("c_nationkey") * 20 + 300).cast("long").alias("last"))
    return P.in_diff(t("events").select("event_id", F.col("user_id").alias("path"), line.alias("line")), ranges).na.fill(-1, ["line"])


@query(f"""WITH x AS (SELECT l_partkey AS k, {LEVEL_SQL} AS s, l_shipdate < TIMESTAMP '1995-06-01' AS old FROM lineitem),
  c AS (SELECT k, count(*) FILTER (NOT old AND s = 'low') AS f0, count(*) FILTER (NOT old AND s = 'medium') AS f1, count(*) FILTER (NOT old AND s = 'high') AS f2,
  count(*) FILTER (old AND s = 'low') AS s0, count(*) FILTER (old AND s = 'medium') AS s1, count(*) FILTER (old AND s = 'high') AS s2 FROM x GROUP BY 1 HAVING count(*) FILTER (NOT old) > 0),
  l AS (SELECT *, greatest(f0 - s0 - s1 - s2, 0) AS n0, greatest(s1 - greatest(f0 - s0, 0), 0) AS r1, greatest(s2 - greatest(f0 - s0 - s1, 0), 0) AS r2 FROM c)
  SELECT k, n0 AS new_low, greatest(f1 - r1 - r2, 0) AS new_medium, greatest(f2 - greatest(r2 - greatest(f1 - r1, 0), 0), 0) AS new_high FROM l""")
def baseline_slots(t, spark, d):
    x = t("lineitem").select(F.col("l_partkey").alias("k"), level().alias("severity"), (F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp")).alias("old"))
    return P.baseline_slots(x.filter("NOT old"), x.filter("old"), "k")


@query("""WITH x AS (SELECT DISTINCT l_partkey AS part, l_returnflag AS rule, l_suppkey AS path, l_shipdate < TIMESTAMP '1995-06-01' AS old FROM lineitem),
  g AS (SELECT *, row_number() OVER (PARTITION BY part, rule, old ORDER BY path) AS r FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE a.part = b.part AND a.rule = b.rule AND a.path = b.path AND a.old <> b.old))
  SELECT a.part, a.rule, a.path AS base_path, b.path AS head_path FROM g a JOIN g b ON a.part = b.part AND a.rule = b.rule AND a.r = b.r AND a.old AND NOT b.old""")
def moved_findings(t, spark, d):
    x = t("lineitem").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("rule"), F.col("l_suppkey").alias("path"), (F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp")).alias("old"))
    return P.moved(x.filter("old").drop("old"), x.filter("NOT old").drop("old"), ["part", "rule"])


@query("""WITH b AS (SELECT p_brand AS file, p_type AS category, p_name AS name, p_name LIKE 'small%' AS anonymous, sum(p_size)::BIGINT AS slots, sum(round(p_retailprice / 40))::BIGINT AS found FROM part GROUP BY 1, 2, 3, 4),
  s AS (SELECT file, category, sum(greatest(slots - found, 0)) AS spare FROM b WHERE anonymous GROUP BY 1, 2),
  o AS (SELECT *, found - slots AS over, sum(found - slots) OVER (PARTITION BY file, category ORDER BY name) - (found - slots) AS before FROM b WHERE NOT anonymous AND found > slots)
  SELECT file, category, name, least(over, greatest(coalesce(spare, 0) - before, 0))::BIGINT AS lent, (over - least(over, greatest(coalesce(spare, 0) - before, 0)))::BIGINT AS excess FROM o LEFT JOIN s USING (file, category)""")
def placeholder_loans(t, spark, d):
    keys = [F.col("p_brand").alias("file"), F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.col("p_name").startswith("small").alias("anonymous")]
    found = F.sum(F.round(F.col("p_retailprice") / 40)).cast("long")
    return P.loans(t("part").groupBy(*keys).agg(F.sum("p_size").cast("long").alias("slots"), found.alias("found")))


@query("""WITH b AS (SELECT o_custkey AS k, count(*) AS base FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), h AS (SELECT o_custkey AS k, count(*) AS head FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
  j AS (SELECT k, coalesce(base, 0) AS base, coalesce(head, 0) AS head FROM b FULL JOIN h USING (k))
  SELECT k, base, head, floor(base * 30 / 100)::BIGINT AS allowed, head - base > floor(base * 30 / 100) AS regressed FROM j""")
def regression_tolerance(t, spark, d):
    side = lambda r: t("orders").filter(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return P.within_tolerance(side(0), side(1), "k", 30)


@query("""WITH m AS (SELECT o_custkey AS file, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS line, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS rule FROM orders),
  f AS (SELECT user_id AS file, event_id % 50 AS line, (event_id % 5 + 1)::VARCHAR AS rule FROM events)
  SELECT file, coalesce(line, -1) AS line, coalesce(rule, '*') AS rule, count(*) AS markers FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.file = m.file AND (m.line IS NULL OR f.line = m.line) AND (m.rule IS NULL OR f.rule = m.rule)) GROUP BY 1, 2, 3""")
def stale_suppressions(t, spark, d):
    o = t("orders")
    m = o.select(F.col("o_custkey").alias("file"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 50).alias("line"), F.when(F.col("o_orderkey") % 4 != 0, F.substring("o_orderpriority", 1, 1)).alias("rule"))
    f = t("events").select(F.col("user_id").alias("file"), (F.col("event_id") % 50).alias("line"), (F.col("event_id") % 5 + 1).cast("string").alias("rule"))
    return P.stale_markers(m, f).na.fill({"line": -1, "rule": "*"}).groupBy("file", "line", "rule").agg(F.count(F.lit(1)).alias("markers"))


@query("""SELECT e AS entry, (SELECT count(*) FROM part WHERE regexp_matches(p_name, r)) AS used FROM (VALUES ('small *', '^small [^/]*$'), ('* gadget', '^[^/]* gadget$'), ('none', '^none$')) v(e, r)""")
def ignore_entries(t, spark, d):
    return P.ignore(t("part"), "p_name", ["small *", "* gadget", "none"])[1]


@query("""SELECT section, n, row_number() OVER (ORDER BY section = '(unowned)', n DESC, section) AS place FROM (
  SELECT CASE WHEN lang IN ('en', 'de') THEN lang ELSE '(unowned)' END AS section, count(*) AS n FROM documents GROUP BY 1)""")
def owner_sections(t, spark, d):
    return P.grouped_counts(t("documents"), F.when(F.col("lang").isin("en", "de"), F.col("lang")))


@query("""SELECT path, CASE WHEN regexp_matches(path, '^/en/[^/]*5$') THEN 'five' WHEN regexp_matches(path, '^/en/.*$') THEN 'english' WHEN regexp_matches(path, '^/[^/]*/1[^/]*$') THEN 'ones' END AS owner
  FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)""")
def code_owners(t, spark, d):
    from ..functions.text import url_path

    return P.code_owners(t("pages").select(url_path(F.col("url")).alias("path")).distinct(), [("/*/1*", "ones"), ("/en/**", "english"), ("/en/*5", "five")])


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 1 WHEN n_regionkey = 1 THEN 2 ELSE 3 END AS ceiling, CASE WHEN c_acctbal > 9000 THEN 'inline' WHEN n_regionkey = 1 THEN 'override' ELSE 'global' END AS layer
  FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def effective_thresholds(t, spark, d):
    c = t("customer")
    inline = c.filter("c_acctbal > 9000").select("c_custkey", F.lit(1).alias("ceiling"))
    override = t("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(2).alias("ceiling"))
    return P.effective_thresholds(c.select("c_custkey", "c_nationkey"), inline, override, 3, "c_custkey", "c_nationkey").drop("c_nationkey")


@query("""WITH c AS (SELECT o_orderkey AS candidate_id, o_custkey AS review_key FROM orders), s AS (SELECT o_orderkey AS candidate_id, o_custkey AS review_key, o_orderstatus AS verdict FROM orders WHERE o_orderpriority = '1-URGENT'),
  k AS (SELECT review_key, min(verdict) AS v FROM s GROUP BY 1 HAVING count(*) = 1), a AS (SELECT review_key FROM c GROUP BY 1 HAVING count(*) = 1)
  SELECT c.candidate_id, c.review_key, coalesce(s.verdict, k.v) AS verdict FROM c LEFT JOIN s USING (candidate_id) LEFT JOIN (SELECT * FROM k SEMI JOIN a USING (review_key)) k ON c.review_key = k.review_key""")
def review_verdicts(t, spark, d):
    o = t("orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("review_key"), F.col("o_orderstatus").alias("verdict"), "o_orderpriority")
    return P.verdicts(o.drop("verdict", "o_orderpriority"), o.filter("o_orderpriority = '1-URGENT'").drop("o_orderpriority"))


@query("""WITH r AS (SELECT json_extract_string(props, '$.k') AS flag, count(*) AS reads, min(ts)::DATE AS since FROM events GROUP BY 1),
  v AS (SELECT p_partkey::VARCHAR AS flag, CASE WHEN p_size > 40 THEN 'archived' ELSE 'live' END AS state FROM part)
  SELECT flag, coalesce(reads, 0) AS reads, concat_ws(',', CASE WHEN v.state IS NULL THEN 'not in vendor' END, CASE WHEN reads IS NULL THEN 'not in code' END, CASE WHEN state = 'archived' THEN 'archived' END,
  CASE WHEN reads = 1 THEN 'single read' END, CASE WHEN date_diff('day', since, DATE '2024-01-31') >= 20 THEN 'old' END) AS reasons FROM r FULL JOIN v USING (flag)""")
def flag_retirement(t, spark, d):
    reads = t("events").select(F.get_json_object("props", "$.k").alias("flag"), "ts")
    vendor = t("part").select(F.col("p_partkey").cast("string").alias("flag"), F.when(F.col("p_size") > 40, "archived").otherwise("live").alias("state"))
    return P.flag_retirement(reads, vendor, "2024-01-31", 20)


def _reports(t):
    return t("part").select(F.col("p_type").alias("rule"), level("p_size").alias("severity"), F.concat(F.lit("src/"), "p_brand").alias("path"), F.col("p_size").alias("line"), F.concat("p_name", F.lit(" | "), "p_partkey").alias("message"))


REPORTS_SQL = """f AS (SELECT p_type AS rule, CASE WHEN p_size > 40 THEN 'error' WHEN p_size > 20 THEN 'warning' ELSE 'note' END AS level, 'src/' || p_brand AS path, p_size AS line, p_name || ' | ' || p_partkey AS message FROM part)"""


@query(f"""WITH {REPORTS_SQL} SELECT to_json({{'ruleId': rule, 'level': level, 'message': {{'text': message}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': path}}, 'region': {{'startLine': line}}}}}}]}})::VARCHAR AS row FROM f""")
def sarif_report(t, spark, d):
    return P.report_rows(_reports(t), "sarif")


@query(f"""WITH {REPORTS_SQL} SELECT to_json({{'description': message, 'check_name': rule, 'fingerprint': sha256(concat_ws('|', rule, path, message)), 'severity': CASE level WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'major' ELSE 'minor' END, 'location': {{'path': path, 'lines': {{'begin': line}}}}}})::VARCHAR AS row FROM f""")
def code_climate_report(t, spark, d):
    return P.report_rows(_reports(t), "codeclimate")


@query(f"WITH {REPORTS_SQL} SELECT '| ' || concat_ws(' | ', rule, path, line::VARCHAR, replace(message, '|', chr(92) || '|')) || ' |' AS row FROM f UNION ALL SELECT '::' || level || ' file=' || path || ',line=' || line || '::' || message FROM f")
def text_reports(t, spark, d):
    return P.report_rows(_reports(t), "markdown").unionByName(P.report_rows(_reports(t), "annotation"))
