"""Queries of scope, gates and merging of findings on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results
from .registry import query


@query("""WITH s AS (SELECT n_name AS file FROM nation WHERE n_regionkey < 2), f AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN n_name END AS anchor, CASE WHEN o_orderstatus = 'P' THEN [n_name, 'x'] ELSE []::VARCHAR[] END AS sites,
    CASE WHEN o_orderpriority = '1-URGENT' THEN [n_name, 'INDIA', 'FRANCE', 'BRAZIL'] ELSE []::VARCHAR[] END AS owners FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  y AS (SELECT list(file) AS every FROM s), k AS (SELECT f.*, list_sort(list_distinct(list_filter(sites, lambda x: list_contains(every, x)))) AS a, list_sort(list_distinct(list_filter(owners, lambda x: list_contains(every, x)))) AS b FROM f, y)
  SELECT id, coalesce(anchor, '-') AS anchor, array_to_string(a, ',') AS sites, array_to_string(b, ',') AS owners FROM k
  WHERE CASE WHEN anchor IS NOT NULL THEN anchor IN (SELECT file FROM s) WHEN len(sites) > 0 THEN len(a) > 0 ELSE true END AND (len(owners) = 0 OR len(b) >= 2)""")
def findings_in_scope(t, spark, d):
    f = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = f.selectExpr("o_orderkey AS id", "CASE WHEN o_orderstatus = 'F' THEN n_name END AS anchor", "CASE WHEN o_orderstatus = 'P' THEN array(n_name, 'x') ELSE cast(array() AS array<string>) END AS sites",
                     "CASE WHEN o_orderpriority = '1-URGENT' THEN array(n_name, 'INDIA', 'FRANCE', 'BRAZIL') ELSE cast(array() AS array<string>) END AS owners")
    out = results.in_scope(f, t("nation").filter("n_regionkey < 2").select(F.col("n_name").alias("file")))
    return out.select("id", F.coalesce("anchor", F.lit("-")).alias("anchor"), F.array_join("sites", ",").alias("sites"), F.array_join("owners", ",").alias("owners"))


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS found FROM orders GROUP BY 1, 2), b AS (SELECT user_id AS o_custkey, '5-LOW' AS o_orderpriority, sum(event_id % 3)::BIGINT AS allowed FROM events GROUP BY 1)
  SELECT o_custkey, o_orderpriority, found, coalesce(allowed, 0) AS allowed, greatest(0, found - coalesce(allowed, 0)) AS over FROM n LEFT JOIN b USING (o_custkey, o_orderpriority)""")
def bucket_overflow(t, spark, d):
    base = t("events").selectExpr("user_id AS o_custkey", "'5-LOW' AS o_orderpriority", "event_id % 3 AS n")
    return results.bucket_overflow(t("orders"), base, ["o_custkey", "o_orderpriority"])


@query("""WITH r AS (SELECT l_returnflag AS rule, l_suppkey AS file, max(CASE WHEN s_nationkey < 8 THEN 3 WHEN s_nationkey < 16 THEN 2 ELSE 1 END) AS r, l_orderkey AS finding FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 4),
  f AS (SELECT rule, finding, max(r) AS r FROM r GROUP BY 1, 2) SELECT rule, count(*) FILTER (r = 3) AS errors, count(*) FILTER (r = 2) AS warnings, count(*) FILTER (r = 3) > 0 AS fails FROM f GROUP BY 1""")
def severity_gate(t, spark, d):
    f = t("lineitem").selectExpr("l_returnflag AS rule", "l_orderkey AS finding", "l_suppkey AS file")
    level = "CASE WHEN s_nationkey < 8 THEN 'error' WHEN s_nationkey < 16 THEN 'warn' ELSE 'off' END AS level"
    rules = t("supplier").selectExpr("explode(array('A', 'N', 'R')) AS rule", "s_suppkey AS file", level)
    return results.severity_gate(f, rules)


@query("""WITH o AS (SELECT n_nationkey AS override, substr(n_name, 1, 3) AS prefix, 'r' || n_regionkey AS rule, CASE WHEN n_nationkey % 2 = 0 THEN 'warn' ELSE 'error' END AS level FROM nation),
  h AS (SELECT DISTINCT prefix FROM o WHERE EXISTS (SELECT 1 FROM region WHERE starts_with(r_name, prefix)))
  SELECT override, 'no-file' AS reason FROM o WHERE prefix NOT IN (SELECT prefix FROM h) UNION SELECT override, 'same-level' FROM o WHERE prefix IN (SELECT prefix FROM h) AND level = CASE WHEN rule < 'r2' THEN 'warn' ELSE 'off' END""")
def ineffective_overrides(t, spark, d):
    o = t("nation").selectExpr("n_nationkey AS override", "substr(n_name, 1, 3) AS prefix", "concat('r', n_regionkey) AS rule", "CASE WHEN n_nationkey % 2 = 0 THEN 'warn' ELSE 'error' END AS level")
    base = t("region").selectExpr("concat('r', r_regionkey) AS rule", "CASE WHEN r_regionkey < 2 THEN 'warn' ELSE 'off' END AS level")
    return results.ineffective_overrides(o, t("region").select(F.col("r_name").alias("path")), base)


@query("""WITH f AS (SELECT c_custkey AS path, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS a, c_acctbal > 3000 AS b, c_nationkey % 3 AS c FROM customer), s AS (SELECT path, (CASE WHEN a > 0 THEN 3 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN c > 0 THEN 1 ELSE 0 END)::BIGINT AS score FROM f)
  SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank, CASE WHEN score >= 4 THEN 'review' ELSE 'skim' END AS list FROM s""")
def focus_map(t, spark, d):
    fan = t("events").groupBy(F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    f = t("customer").selectExpr("c_custkey AS path", "cast(c_acctbal > 3000 AS int) AS churn", "c_nationkey % 3 AS complexity").join(fan, "path", "left")
    return results.focus_map(f, 4)


@query("""WITH b AS (SELECT user_id AS key, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view_, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS signup FROM events GROUP BY 1)
  SELECT 'weakened-tests' AS rule, key::VARCHAR AS key FROM b WHERE view_ < click UNION SELECT 'added-suppression', key::VARCHAR FROM b WHERE error > click UNION SELECT 'test-only-branch', key::VARCHAR FROM b WHERE signup > click
  UNION SELECT 'added-dependency', c_custkey::VARCHAR FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(*) FILTER (o_orderstatus = 'P') = 0 AND count(o_orderkey) > 0
  UNION SELECT 'diverged-clone-sibling', l_orderkey::VARCHAR FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R') AND NOT bool_and(l_returnflag = 'R')""")
def diff_risks(t, spark, d):
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    side = lambda kind: t("events").groupBy(F.col("user_id").alias("key")).agg(n("click").alias("base"), n(kind).alias("head"))
    o = t("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("base"), F.count(F.lit(1)).alias("head"))
    return results.diff_risks(side("view"), side("error"), o, t("lineitem").selectExpr("l_orderkey AS key", "l_returnflag = 'R' AS changed"), side("signup"))


@query("""WITH a AS (SELECT o_custkey AS key, count(*) AS n, max(o_orderstatus) AS first_status FROM orders WHERE o_totalprice > 300000 GROUP BY 1), b AS (SELECT o_custkey AS key, count(*) AS n, min(o_orderstatus) AS first_status FROM orders GROUP BY 1)
  SELECT key, (coalesce(a.n, 0) + b.n)::BIGINT AS n, coalesce(a.first_status, b.first_status) AS first_status FROM b LEFT JOIN a USING (key)""")
def merged_inventory(t, spark, d):
    o = t("orders").withColumnRenamed("o_custkey", "key")
    a = o.filter("o_totalprice > 300000").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("first_status"))
    b = o.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderstatus").alias("first_status"))
    return results.merged_inventory([a, b], ["key"], ["n"], ["first_status"])


@query("SELECT l_returnflag AS kind, l_linestatus AS path, l_linenumber::VARCHAR AS message FROM lineitem UNION SELECT o_orderstatus, o_orderpriority, 'order' FROM orders")
def merged_diagnostics(t, spark, d):
    a = t("lineitem").selectExpr("l_returnflag AS kind", "l_linestatus AS path", "cast(l_linenumber AS string) AS message")
    return results.merged_diagnostics(a, t("orders").selectExpr("o_orderstatus AS kind", "o_orderpriority AS path", "'order' AS message"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def lean_report(t, spark, d):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return results.lean(o, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 20)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN 'found' WHEN c_custkey IN (SELECT s_suppkey + 100 FROM supplier) THEN 'suppressed' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'fixed' ELSE 'unknown' END AS answer FROM customer""")
def finding_lookup(t, spark, d):
    one = lambda table, e: t(table).selectExpr(f"{e} AS id")
    return results.finding_lookup(one("customer", "c_custkey"), one("events", "user_id"), t("orders").filter("o_totalprice > 400000").selectExpr("o_custkey AS id"), one("supplier", "s_suppkey + 100"))


@query("SELECT o_orderpriority AS source, count(*) AS entries, count(DISTINCT o_custkey) AS paths FROM orders GROUP BY 1")
def entry_summary(t, spark, d):
    return results.entry_summary(t("orders").selectExpr("o_orderpriority AS source", "o_custkey AS path"))


@query("SELECT 'entries' AS kind, r_name AS name FROM region UNION SELECT 'files', p_name FROM part UNION SELECT 'plugins', p_brand FROM part UNION SELECT 'zones', n_name FROM nation")
def list_inventory(t, spark, d):
    name = lambda table, c: t(table).select(F.col(c).alias("name"))
    return results.inventory(files=name("part", "p_name"), zones=name("nation", "n_name"), plugins=name("part", "p_brand"), entries=name("region", "r_name"))
