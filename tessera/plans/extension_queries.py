"""Queries of plugins, config layers, gates and limits on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clones, extensions as E, health
from ..streaming import sessions
from .registry import query


@query("""WITH a AS (SELECT DISTINCT n_regionkey AS plugin FROM nation WHERE n_name IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000) OR n_name LIKE 'CH%')
  SELECT plugin FROM a""")
def active_plugins(t, spark, d):
    enablers = t("nation").selectExpr("n_regionkey AS plugin", "CASE WHEN n_name LIKE 'CH%' THEN 'CH*' ELSE n_name END AS package")
    have = t("nation").join(t("supplier").filter("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("package"))
    return E.active_plugins(enablers, have.unionByName(t("nation").filter("n_name LIKE 'CH%'").select(F.col("n_name").alias("package"))))


@query("""SELECT DISTINCT 'file' AS kind, p_name AS key, 'entry' AS role FROM part WHERE p_name LIKE 'small%' UNION SELECT DISTINCT 'file', p_name, 'config' FROM part WHERE p_name LIKE '%ring' UNION SELECT 'name', 'widget', 'used-member'""")
def plugin_credits(t, spark, d):
    rules = spark.createDataFrame([("a", "entry", "^small"), ("a", "config", "ring$"), ("a", "used-member", "widget"), ("b", "entry", "^red")], "plugin string, role string, pattern string")
    return E.plugin_credits(rules, spark.createDataFrame([("a",)], "plugin string"), t("part").select(F.col("p_name").alias("path")))


@query("""WITH l AS (SELECT c_custkey AS key, c_mktsegment AS value, 'a' AS source, 1 AS rank FROM customer UNION ALL SELECT o_custkey, max(o_orderpriority), 'b', 2 FROM orders WHERE o_totalprice > 400000 GROUP BY 1 UNION ALL SELECT user_id, NULL, 'c', 3 FROM events)
  SELECT key, arg_max(value, rank) AS value, arg_max(source, rank) AS source FROM l WHERE value IS NOT NULL GROUP BY 1""")
def layered_config(t, spark, d):
    a = t("customer").selectExpr("c_custkey AS key", "c_mktsegment AS value", "'a' AS source", "1 AS rank")
    b = t("orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("value")).selectExpr("key", "value", "'b' AS source", "2 AS rank")
    return E.layered_config(a.unionByName(b).unionByName(t("events").selectExpr("user_id AS key", "cast(NULL AS string) AS value", "'c' AS source", "3 AS rank")))


@query("""SELECT o_orderkey AS finding, o_orderpriority AS rule, CASE o_orderpriority WHEN '1-URGENT' THEN 'error' ELSE 'warn' END AS level FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '5-LOW')""")
def gated_findings(t, spark, d):
    rules = spark.createDataFrame([("1-URGENT", True, "error"), ("2-HIGH", False, "error"), ("5-LOW", True, "off"), ("3-MEDIUM", None, None)], "rule string, enabled boolean, level string")
    return E.gated_rules(t("orders").selectExpr("o_orderkey AS finding", "o_orderpriority AS rule"), rules, "warn")


@query("""WITH f AS (SELECT doc_id AS fn, source AS path, n_chars AS bytes, CASE WHEN n_chars < 200 THEN 'too-short' WHEN n_chars > 8000 THEN 'too-large' END AS reason FROM documents), s AS (SELECT *, sum(CASE WHEN reason IS NULL THEN bytes ELSE 0 END) OVER (ORDER BY path, fn) AS spent FROM f)
  SELECT fn, coalesce(reason, CASE WHEN spent > 500000 THEN 'over-budget' END, '-') AS reason FROM s""")
def limited_functions(t, spark, d):
    f = t("documents").selectExpr("doc_id AS fn", "source AS path", "n_chars AS lines", "n_chars AS bytes")
    return E.limited_functions(f, 200, 8000, 500_000).fillna("-", ["reason"])


@query("""SELECT DISTINCT user_id AS a, json_extract_string(props, '$.k')::BIGINT AS b FROM events WHERE user_id IN (SELECT n_nationkey FROM nation) OR json_extract_string(props, '$.k')::BIGINT IN (SELECT n_nationkey FROM nation)""")
def pairs_in_scope(t, spark, d):
    pairs = t("events").select(F.col("user_id").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b"))
    return E.pairs_in_scope(pairs, t("nation").select(F.col("n_nationkey").cast("long").alias("id")))


@query("""WITH r AS (SELECT p_size AS path, min(p_brand) AS key FROM part WHERE p_type = 'SMALL' GROUP BY 1 HAVING count(DISTINCT p_brand) = 1) SELECT s_suppkey AS site, coalesce(key, '-') AS key FROM supplier LEFT JOIN r ON path = s_nationkey""")
def flag_registry(t, spark, d):
    registry = t("part").filter("p_type = 'SMALL'").selectExpr("p_size AS path", "p_brand AS key")
    return E.flag_keys(t("supplier").selectExpr("s_suppkey AS site", "s_nationkey AS path"), registry).fillna("-", ["key"])


@query("""SELECT o_orderkey AS mutant, (SELECT count(DISTINCT event_type) FROM events WHERE user_id = o_custkey) AS tests FROM orders""")
def runner_reach(t, spark, d):
    return E.runner_reach(t("orders").selectExpr("o_orderkey AS mutant", "o_custkey AS file"), t("events").selectExpr("event_type AS test", "user_id AS file"))


@query("""SELECT DISTINCT page_id, w AS name FROM (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, '[a-z0-9\\-]+')), '^-+|-+$', '', 'g') AS w FROM pages) WHERE length(w) >= 2 AND regexp_matches(w, '[a-z]')""")
def class_shaped_tokens(t, spark, d):
    return t("pages").select("page_id", F.explode(E.class_shaped(F.col("html"))).alias("name"))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'md:' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END || CASE p_type WHEN 'SMALL' THEN 'mt-' WHEN 'LARGE' THEN 'text-' WHEN 'MEDIUM' THEN 'text-red-' ELSE 'own-' END || p_size AS name FROM part)
  SELECT name, CASE WHEN name LIKE '%mt-%' THEN 'spacing' WHEN name LIKE '%text-red-%' THEN 'color' ELSE 'font' END AS namespace FROM n WHERE name NOT LIKE '%own-%'""")
def utility_classes(t, spark, d):
    name = "concat(CASE WHEN p_size % 3 = 0 THEN 'md:' ELSE '' END, CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END, CASE p_type WHEN 'SMALL' THEN 'mt-' WHEN 'LARGE' THEN 'text-' WHEN 'MEDIUM' THEN 'text-red-' ELSE 'own-' END, p_size) AS name"
    prefixes = spark.createDataFrame([("mt", "spacing"), ("text", "font"), ("text-red", "color")], "prefix string, namespace string")
    return E.utility_classes(t("part").selectExpr(name), prefixes)


@query("SELECT DISTINCT p_brand AS variant, p_size AS token FROM part WHERE p_size NOT IN (SELECT s_nationkey FROM supplier)")
def variant_drift(t, spark, d):
    return E.variant_drift(t("part").selectExpr("p_brand AS variant", "p_size AS token"), t("supplier").selectExpr("s_nationkey AS token"))


@query("SELECT DISTINCT p_brand AS file FROM part WHERE p_name LIKE 'red%' AND p_size < 20 OR p_name LIKE 'small r%' AND p_size < 20")
def packages_with(t, spark, d):
    return E.packages_with(t("part").filter("p_size < 20").selectExpr("p_brand AS file", "p_name AS name"), ["red", "small r"])


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 hour THEN 0 ELSE 1 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e)
  SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id AS key, count(*) AS events FROM g GROUP BY user_id, run""")
def quiet_runs(t, spark, d):
    runs = sessions.quiet_runs(t("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key")), "1 hour")
    return runs.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "key", "events")


@query("""SELECT strftime(ts::DATE, '%Y-%m-%d') AS start, user_id AS path, count(*) AS commits, sum(event_id % 10)::BIGINT AS lines FROM events GROUP BY 1, 2""")
def churn_windows(t, spark, d):
    w = sessions.churn_windows(t("events").selectExpr("cast(ts AS timestamp) AS ts", "user_id AS path", "event_id % 10 AS lines"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "path", "commits", "lines")


@query("SELECT o_custkey AS key, o_orderdate AS version, o_orderkey AS result FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)")
def newest_results(t, spark, d):
    o = t("orders").selectExpr("o_custkey AS key", "o_orderdate AS version", "o_orderkey AS result")
    return sessions.newest(o, o)


@query("""WITH w AS (SELECT conv_id * 100 + turn AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS w FROM conversations), s AS (SELECT min(id) AS id, w FROM w WHERE len(w) > 0 GROUP BY w)
  SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS shared, len(list_distinct(list_concat(a.w, b.w))) AS total FROM s a JOIN s b ON a.id < b.id WHERE 100 * len(list_intersect(a.w, b.w)) >= 25 * len(list_distinct(list_concat(a.w, b.w)))""")
def near_misses(t, spark, d):
    return clones.near_misses(t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), clones.words_of(F.col("text")).alias("w")), 25)


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), k AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 5), lambda i: array_to_string(w[i:i + 6], ' '))) AS h FROM w)
  SELECT DISTINCT doc_id FROM k WHERE h IN (SELECT h FROM k JOIN documents USING (doc_id) WHERE source = 'src3')""")
def near_focus(t, spark, d):
    return clones.near_focus(t("documents"), t("documents").filter("source = 'src3'"), 50)


@query("""WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS first, o_orderkey + 20 + o_orderkey % 40 AS last, o_orderkey % 90 AS of_doc, 10 * (o_orderkey % 7) AS of_first FROM orders),
  h AS (SELECT of_doc, of_first, last - first + 1 AS length, doc_id FROM r WHERE last - first + 1 >= 40), e AS (SELECT * FROM h UNION ALL SELECT DISTINCT of_doc, of_first, length, of_doc FROM h)
  SELECT of_doc, of_first, length, count(*) AS instances, count(DISTINCT doc_id) AS files FROM e GROUP BY 1, 2, 3 HAVING bool_or(doc_id IN (SELECT n_nationkey FROM nation)) AND count(DISTINCT doc_id) > 1""")
def focused_groups(t, spark, d):
    r = t("orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS first", "o_orderkey + 20 + o_orderkey % 40 AS last", "o_orderkey % 90 AS of_doc", "10 * (o_orderkey % 7) AS of_first")
    return clones.instance_groups(r, t("nation").select(F.col("n_nationkey").cast("long").alias("doc_id")), 40)


@query("""WITH t AS (SELECT conv_id * 100 + turn AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS token FROM conversations) SELECT token, count(*) AS n, count(DISTINCT id) AS files FROM t GROUP BY 1""")
def fragment_tokens(t, spark, d):
    rows = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.explode(clones.fragment_tokens(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("files"))


@query("""SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey * 100 + l_suppkey) - 1 AS pos, l_partkey AS text FROM lineitem WHERE l_returnflag <> 'A'""")
def untyped_tokens(t, spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "type").otherwise("name").alias("kind")
    rows = t("lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("pos"), kind, F.col("l_partkey").alias("text"))
    return clones.without_types(rows).select("file", "pos", "text")


@query("""WITH g AS (SELECT l_partkey AS "group", count(*) AS instances, max(l_quantity)::BIGINT AS length FROM lineitem GROUP BY 1) SELECT * FROM g WHERE "group" IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3) ORDER BY length * (instances - 1) DESC, "group" LIMIT 15""")
def largest_groups(t, spark, d):
    line = t("lineitem")
    g = line.groupBy(F.col("l_partkey").alias("group")).agg(F.count(F.lit(1)).alias("instances"), F.max("l_quantity").cast("long").alias("length"))
    return clones.largest_groups(g, line.selectExpr("l_partkey AS group", "l_suppkey AS file"), t("supplier").filter("s_nationkey = 3").selectExpr("s_suppkey AS file"), 15)


@query("""SELECT p_brand || p_name || p_type AS "group" FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 5) = 1""")
def local_groups(t, spark, d):
    members = t("part").selectExpr("concat(p_brand, p_name, p_type) AS group", "concat('f', p_size % 5, '/', p_partkey) AS file")
    return clones.local_only(members.select("group").distinct(), members)


@query("""SELECT o_orderkey AS fn, o_custkey % 30 AS cyclomatic, CASE WHEN c_nationkey < 5 THEN c_nationkey + 5 ELSE 20 END::BIGINT AS ceiling FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 30 > CASE WHEN c_nationkey < 5 THEN c_nationkey + 5 ELSE 20 END""")
def inline_complexity(t, spark, d):
    f = t("orders").selectExpr("o_orderkey AS fn", "o_custkey AS path", "o_custkey % 30 AS cyclomatic")
    return health.over_threshold(f, t("customer").filter("c_nationkey < 5").selectExpr("c_custkey AS path", "c_nationkey + 5 AS ceiling"), 20)
