"""Queries of component, route, zone and policy rules on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, dead_code
from ..sources.facts import PAIRS_SQL, pairs
from .registry import query

WITH = "WITH " + PAIRS_SQL


def of(t, kind, *names):
    return pairs(t, kind).select(F.col("owner").alias(names[0]), F.col("name").alias(names[1]))


@query(WITH + " SELECT owner, name FROM pairs WHERE kind = 'signup' AND (owner, name) NOT IN (SELECT owner, name FROM pairs WHERE kind = 'click') AND owner NOT IN (SELECT owner FROM pairs WHERE kind = 'error' AND name = 7)")
def unused_component_props(t, spark, d):
    open_ended = pairs(t, "error").filter("name = 7")
    return components.never_matched(pairs(t, "signup"), pairs(t, "click"), ["owner", "name"], open_ended, "owner")


@query(WITH + " SELECT owner, name FROM pairs WHERE kind = 'view' EXCEPT SELECT owner, name FROM pairs WHERE kind = 'purchase'")
def unused_component_emits(t, spark, d):
    return components.never_matched(pairs(t, "view"), pairs(t, "purchase"), ["owner", "name"])


@query("SELECT DISTINCT o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unprovided_injects(t, spark, d):
    return components.never_matched(t("orders").select(F.col("o_orderkey").alias("name")), t("lineitem").select(F.col("l_orderkey").alias("name")), ["name"])


@query("SELECT c_custkey AS component FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
def unrendered_components(t, spark, d):
    found = components.never_matched(t("customer").select(F.col("c_custkey").alias("component")), t("events").select(F.col("user_id").alias("component")), ["component"])
    return components.unless_any(found, t("orders").filter("o_totalprice < 0"))


@query(WITH + " SELECT name FROM (SELECT DISTINCT name FROM pairs WHERE kind = 'signup' AND owner < 20) WHERE name NOT IN (SELECT name FROM pairs WHERE kind = 'error' AND owner > 147)")
def unused_svelte_events(t, spark, d):
    return components.never_matched(pairs(t, "signup").filter("owner < 20"), pairs(t, "error").filter("owner > 147"), ["name"])


@query("WITH RECURSIVE " + PAIRS_SQL + """, h AS (SELECT owner AS class, name AS base FROM pairs WHERE kind = 'error' AND owner > name), s AS (SELECT base, class FROM h UNION SELECT s.base, h.class FROM s JOIN h ON h.base = s.class),
  u AS (SELECT owner, name FROM pairs WHERE kind = 'click' UNION SELECT base, name FROM pairs JOIN s ON owner = class WHERE kind = 'click' AND owner > 140)
  SELECT owner, name FROM pairs WHERE kind = 'view' EXCEPT SELECT owner, name FROM u""")
def unused_component_inputs(t, spark, d):
    index = dead_code.subclass_index(pairs(t, "error").filter("owner > name").selectExpr("owner AS class", "name AS base"))
    return components.unused_inputs(pairs(t, "view"), pairs(t, "click"), index.filter("class > 140"))


@query(WITH + """ SELECT p.component, prop, sites FROM (SELECT owner AS component, name AS prop FROM pairs WHERE kind = 'signup' EXCEPT SELECT owner, name FROM pairs WHERE kind = 'purchase') p
  JOIN (SELECT o_custkey AS component, count(*) AS sites FROM orders GROUP BY 1) USING (component)""")
def absent_component_props(t, spark, d):
    sites = t("orders").selectExpr("o_custkey AS component", "o_orderkey AS site")
    return components.absent_props(of(t, "signup", "component", "prop"), sites, of(t, "purchase", "component", "prop"))


@query("""WITH n AS (SELECT user_id AS name FROM events WHERE event_type = 'signup')
  SELECT 'unused-load-data-key' AS rule, name FROM (SELECT DISTINCT c_custkey AS name FROM customer WHERE c_custkey < 300 EXCEPT SELECT name FROM n)""")
def unused_load_data_keys(t, spark, d):
    keys = t("customer").filter("c_custkey < 300").select(F.col("c_custkey").alias("name"))
    found = components.never_matched(keys, t("events").filter("event_type = 'signup'").select(F.col("user_id").alias("name")), ["name"])
    return components.unless_any(found, t("events").filter("value < 0")).select(F.lit("unused-load-data-key").alias("rule"), "name")


@query("""WITH l AS (SELECT c_custkey AS name FROM customer), o AS (SELECT o_custkey AS name FROM orders), e AS (SELECT user_id AS name FROM events), s AS (SELECT s_suppkey AS name FROM supplier)
  SELECT 'unused-effect-layer' AS rule, name FROM (SELECT name FROM l EXCEPT SELECT name FROM s) UNION ALL SELECT 'unused-tagged-error', name FROM (SELECT name FROM e EXCEPT SELECT name FROM s)
  UNION ALL SELECT 'unproduced-catch-tag', name FROM (SELECT name FROM o EXCEPT SELECT name FROM s)""")
def effect_findings(t, spark, d):
    one = lambda table, c: t(table).select(F.col(c).alias("name"))
    return components.effect_findings(one("customer", "c_custkey"), one("supplier", "s_suppkey"), one("events", "user_id"), one("supplier", "s_suppkey"), one("orders", "o_custkey"))


@query("""WITH c AS (SELECT c_custkey AS component, c_acctbal > 0 AS spread, c_nationkey % 3 AS complexity, c_nationkey % 2 AS hooks FROM customer), r AS (SELECT o_custkey AS component, min(o_orderkey) AS child, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
  SELECT component, child FROM c JOIN r USING (component) WHERE spread AND complexity <= 1 AND hooks = 0 AND n = 1 AND child <> component AND component NOT IN (SELECT user_id FROM events)""")
def thin_wrapper_components(t, spark, d):
    c = t("customer").selectExpr("c_custkey AS component", "c_acctbal > 0 AS spread", "c_nationkey % 3 AS complexity", "c_nationkey % 2 AS hooks")
    r = t("orders").filter("o_orderpriority = '1-URGENT'").selectExpr("o_custkey AS component", "o_orderkey AS child")
    return components.thin_wrappers(c, r, t("events").select(F.col("user_id").alias("component")))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS component, c_nationkey AS file, o_orderpriority AS prop FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey NOT IN (SELECT user_id FROM events) AND o_orderpriority <> '5-LOW'),
  s AS (SELECT component, file, string_agg(prop, ',' ORDER BY prop) AS shape, count(*) AS n FROM p GROUP BY 1, 2) SELECT shape, count(*) AS members, count(DISTINCT file) AS files FROM s WHERE n >= 3 GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT file) >= 2""")
def duplicate_component_shapes(t, spark, d):
    p = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_custkey AS component", "c_nationkey AS file", "o_orderpriority AS prop")
    return components.duplicate_shapes(p, ["5-LOW"], t("events").select(F.col("user_id").alias("component")), least_props=3)


@query("""WITH r AS (SELECT p_brand, p_type, p_size, p_partkey, p_retailprice > 905 AS hidden FROM part), g AS (SELECT *, list(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS every FROM r)
  SELECT p_brand, p_type, p_size, p_partkey, array_to_string(list_sort(list_filter(every, lambda x: x <> p_partkey)), ',') AS siblings FROM g WHERE len(every) >= 2 AND NOT hidden""")
def colliding_routes(t, spark, d):
    return components.colliding_routes(t("part").withColumn("hidden", F.col("p_retailprice") > 905), ["p_brand", "p_type", "p_size"], "p_partkey", "hidden")


@query("""SELECT c_custkey AS component, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS sites, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS parents,
  (SELECT count(DISTINCT event_type) FROM events WHERE user_id = c_custkey) AS props, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS hooks FROM customer""")
def component_facts(t, spark, d):
    named = lambda df, c, **more: df.select(F.col(c).alias("component"), *[F.col(v).alias(k) for k, v in more.items()])
    return components.component_facts(named(t("customer"), "c_custkey"), named(t("orders"), "o_custkey", parent="o_orderpriority"), named(t("events"), "user_id", prop="event_type"), named(t("events"), "user_id"))


@query("""SELECT o_orderpriority AS rule, count(DISTINCT o_custkey) AS roster, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS reported FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def gated_population(t, spark, d):
    severity = spark.createDataFrame([("1-URGENT", "error"), ("2-HIGH", "warn"), ("3-MEDIUM", "warn"), ("4-NOT SPECIFIED", "warn"), ("5-LOW", "off")], "rule string, level string")
    return components.gated_population(t("orders").selectExpr("o_orderpriority AS rule", "o_custkey AS member", "o_orderstatus = 'P' AS suppressed"), severity)


@query("SELECT DISTINCT o_custkey AS file, o_orderpriority AS name FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT user_id FROM events)")
def invalid_client_exports(t, spark, d):
    return components.invalid_client_exports(t("orders").selectExpr("o_custkey AS file", "o_orderpriority AS name"), t("events").select(F.col("user_id").alias("file")), ["1-URGENT", "2-HIGH"])


@query("SELECT c_custkey AS file FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def server_only_files(t, spark, d):
    packages = spark.createDataFrame([("error",)], "package string")
    imports = t("events").filter("value > 100").selectExpr("user_id AS file", "event_type AS package")
    return components.server_only(t("customer").select(F.col("c_custkey").alias("file")), t("orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("file")), imports, packages)


@query("SELECT c_custkey AS file FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def uncovered_files(t, spark, d):
    allowed = t("customer").join(t("nation").filter("n_regionkey = 0"), F.col("c_nationkey") == F.col("n_nationkey"))
    file = F.col("c_custkey").alias("file")
    return components.uncovered_files(t("customer").select(file), t("events").select(F.col("user_id").alias("file")), allowed.select(file))


@query("""WITH c AS (SELECT DISTINCT user_id AS file, CASE event_type WHEN 'click' THEN 'run.now' WHEN 'view' THEN 'console.log' WHEN 'error' THEN 'cp.exec' ELSE 'fetch' END AS callee FROM events),
  z AS (SELECT c_custkey AS file, CASE WHEN c_nationkey < 10 THEN 'ui' ELSE 'db' END AS zone FROM customer WHERE c_acctbal > 0),
  m AS (SELECT file, callee, zone, CASE WHEN callee = 'run.now' AND file % 2 = 0 THEN 'child_process.exec.now' WHEN callee = 'cp.exec' THEN 'child_process.exec' END AS canonical FROM c JOIN z USING (file))
  SELECT file, callee, zone, CASE WHEN zone = 'db' THEN 'console.*' WHEN canonical LIKE 'child_process.%' THEN 'child_process.*' ELSE 'fetch' END AS pattern FROM m
  WHERE zone = 'ui' AND (canonical LIKE 'child_process.%' OR callee = 'fetch') OR zone = 'db' AND callee LIKE 'console.%'""")
def forbidden_calls(t, spark, d):
    callee = "CASE event_type WHEN 'click' THEN 'run.now' WHEN 'view' THEN 'console.log' WHEN 'error' THEN 'cp.exec' ELSE 'fetch' END AS callee"
    calls = t("events").selectExpr("user_id AS file", callee)
    zones = t("customer").filter("c_acctbal > 0").selectExpr("c_custkey AS file", "CASE WHEN c_nationkey < 10 THEN 'ui' ELSE 'db' END AS zone")
    files = t("customer").selectExpr("c_custkey AS file")
    imports = files.filter("file % 2 = 0").selectExpr("file", "'run' AS local", "'node:child_process' AS package", "'exec' AS imported", "false AS type_only")
    imports = imports.unionByName(files.selectExpr("file", "'cp' AS local", "'child_process' AS package", "cast(NULL AS string) AS imported", "false AS type_only"))
    imports = imports.unionByName(files.selectExpr("file", "'console' AS local", "'./own' AS package", "'log' AS imported", "false AS type_only"))
    patterns = spark.createDataFrame([("ui", "child_process.*", 0), ("ui", "fetch", 1), ("ui", "child_process.exec", 2), ("db", "console.*", 3)], "zone string, pattern string, ordinal int")
    return components.forbidden_calls(calls, zones, imports, patterns)


@query("""WITH f AS (SELECT DISTINCT p_partkey AS file, 'import' AS kind, p_brand || '/' || p_type AS name FROM part) SELECT file, name, 'no-economy' AS rule FROM f WHERE name LIKE '%/ECONOMY' AND name LIKE 'Brand#1/%'
  UNION SELECT file, name, 'no-brand-2' FROM f WHERE name LIKE 'Brand#2/%'""")
def policy_violations(t, spark, d):
    rules = spark.createDataFrame([("no-economy", "import", "Brand#1/ECONOMY"), ("no-brand-2", "import", "Brand#2"), ("no-call", "call", "Brand#3")], "rule string, kind string, prefix string")
    return components.policy_violations(t("part").selectExpr("p_partkey AS file", "'import' AS kind", "concat(p_brand, '/', p_type) AS name"), rules)


@query("""WITH k AS (SELECT unnest(['SMALL', 'LARGE', 'MEDIUM', 'ECO']) AS k), n AS (SELECT DISTINCT p_type AS name FROM part)
  SELECT name, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN starts_with(lower(name), lower(k)) OR starts_with(lower(k), lower(name)) THEN 0 ELSE 1 END, levenshtein(lower(name), lower(k)), k) AS rank, k AS nearest FROM n, k QUALIFY rank <= 2""")
def nearest_names(t, spark, d):
    return components.nearest_name(t("part").select(F.col("p_type").alias("name")), ["SMALL", "LARGE", "MEDIUM", "ECO"], 2)
