"""Queries that run each operator on the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import clones, detectors, extensions, graphs, health, metrics, results, security
from ..sources.tables import CALLS_SQL, LINES_SQL, calls, lines
from ..streaming import history
from .registry import query

# detectors ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unused_declarations(t, spark, d):
    return detectors.unused(t("orders").select("o_orderkey"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""SELECT l_partkey AS part, count(*) AS uses, min(l_orderkey) AS first_site FROM lineitem
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1""")
def unlisted_dependencies(t, spark, d):
    used = t("lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey")
    return detectors.unlisted(used, t("part").filter("p_size <= 25").select(F.col("p_partkey").alias("part")), "part", "l_orderkey")


@query("SELECT p_type, count(DISTINCT p_brand) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def duplicate_exports(t, spark, d):
    return detectors.shared_names(t("part"), "p_type", "p_brand")


@query("SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1 HAVING bool_and(l_discount < 0.08)")
def always_flagged_dependencies(t, spark, d):
    return detectors.always(t("lineitem"), "l_partkey", F.col("l_discount") < 0.08)


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'N')")
def mixed_barrels(t, spark, d):
    return detectors.both(t("lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_returnflag") == "N")


@query("""SELECT o_custkey, min(o_orderpriority) AS value, count(*) AS calls FROM orders GROUP BY 1
  HAVING count(DISTINCT o_orderpriority) = 1 AND count(*) >= 2 AND bool_and(o_orderpriority IS NOT NULL)""")
def constant_parameters(t, spark, d):
    return detectors.constant_values(t("orders"), "o_custkey", "o_orderpriority")


@query("""SELECT * FROM (SELECT p_brand, p_type, p_size, p_partkey, count(*) OVER (PARTITION BY p_brand, p_type, p_size) - 1 AS others FROM part)
  WHERE others >= 1""")
def route_collisions(t, spark, d):
    return detectors.collisions(t("part"), ["p_brand", "p_type", "p_size"], "p_partkey")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'unreferenced' ELSE 'unresolved' END AS side
  FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b USING (doc_id)
  WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def catalog_difference(t, spark, d):
    return detectors.catalog_difference(t("documents"), t("labels"), "doc_id")


@query("WITH " + CALLS_SQL + """, z AS (SELECT c_custkey AS node, n_regionkey::BIGINT AS zone FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT src, dst, a.zone AS zone_a, b.zone AS zone_b FROM edges JOIN z a ON src = a.node JOIN z b ON dst = b.node
  WHERE a.zone <> b.zone AND NOT (b.zone = a.zone + 1)""")
def boundary_violations(t, spark, d):
    zones = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("node"), F.col("n_regionkey").cast("long").alias("zone"))
    allowed = t("region").select(F.col("r_regionkey").cast("long").alias("zone_a"), (F.col("r_regionkey") + 1).cast("long").alias("zone_b"))
    return detectors.boundary_violations(calls(spark, d), zones, allowed)


@query("""SELECT shape, count(*) AS owners FROM (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS shape,
  count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) WHERE n >= 4 GROUP BY 1 HAVING count(*) >= 3""")
def duplicate_prop_shapes(t, spark, d):
    return detectors.shared_shapes(t("orders"), "o_custkey", "o_orderpriority")


@query("""WITH f AS (SELECT p_partkey, count(DISTINCT l_suppkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1),
  r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS c FROM f), p AS (SELECT min(n) AS p95 FROM r WHERE i >= ceil(c * 0.95))
  SELECT p95, greatest(p95, 10)::BIGINT AS threshold, round(100 * sum((n > greatest(p95, 10))::INT) / count(*), 1) AS high_percent, max(n) AS most
  FROM f, p GROUP BY p95""")
def fan_in_percentile(t, spark, d):
    uses = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return detectors.fan_in_summary(t("part"), uses, "p_partkey", "l_suppkey")


@query("""WITH x AS (SELECT a.n_name AS name, b.n_name AS other, levenshtein(lower(a.n_name), lower(b.n_name)) AS distance FROM nation a, nation b)
  SELECT name, other, distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, other) AS r FROM x
  WHERE distance BETWEEN 1 AND 2 AND length(name) // 2 > distance) WHERE r = 1""")
def typo_suggestions(t, spark, d):
    names = t("nation").select(F.col("n_name").alias("name"))
    return detectors.closest_names(names, names)


# graphs ---------------------------------------------------------------------------------------------------------------


@query("WITH " + CALLS_SQL + """, e AS (SELECT * FROM edges WHERE src <> dst), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
  SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS fan_in, (SELECT count(*) FROM e WHERE src = node) AS fan_out FROM n""")
def fan_in_out(t, spark, d):
    return graphs.fan(calls(spark, d))


@query("WITH RECURSIVE " + CALLS_SQL + """, r AS (SELECT 3::BIGINT AS node, 0::BIGINT AS depth UNION SELECT dst, depth + 1 FROM r JOIN edges ON node = src WHERE depth < 100)
  SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def reachability(t, spark, d):
    return graphs.reach(calls(spark, d), spark.range(3, 4).toDF("node"))


@query("WITH RECURSIVE " + CALLS_SQL + """, s AS (SELECT 3::BIGINT AS node, 0::BIGINT AS depth UNION SELECT dst, depth + 1 FROM s JOIN edges ON node = src WHERE depth < 100),
  b AS (SELECT node, min(depth) AS depth FROM s GROUP BY 1),
  r AS (SELECT 3::BIGINT AS node, [3::BIGINT] AS path UNION SELECT dst, list_append(path, dst) FROM r JOIN edges ON r.node = src JOIN b ON b.node = dst AND b.depth = len(path))
  SELECT node, array_to_string(min(path), '>') AS path FROM r GROUP BY 1""")
def shortest_import_paths(t, spark, d):
    return graphs.shortest_paths(calls(spark, d), 3)


@query("WITH RECURSIVE " + CALLS_SQL + """, r AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src AND e.src <> e.dst)
  SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1""")
def import_cycles(t, spark, d):
    return graphs.strong_components(calls(spark, d))


@query("WITH RECURSIVE " + CALLS_SQL + """, r AS (SELECT 3::BIGINT AS node UNION SELECT dst FROM r JOIN edges ON node = src),
  s AS (SELECT o_custkey AS node, count(*) AS size FROM orders GROUP BY 1)
  SELECT count(*) AS modules, sum(size)::BIGINT AS bytes FROM r JOIN s USING (node)""")
def entry_weight(t, spark, d):
    sizes = t("orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    return graphs.entry_weight(calls(spark, d), 3, sizes)


# clones ---------------------------------------------------------------------------------------------------------------


@query("WITH " + LINES_SQL + " SELECT line, count(DISTINCT doc_id) AS files, count(*) AS instances FROM lines GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def clone_groups(t, spark, d):
    return clones.clone_groups(lines(spark, d))


@query("WITH " + LINES_SQL + """ SELECT min(first_file) AS first_file, min(n) AS files, count(*) AS groups FROM (SELECT line, min(doc_id) AS first_file, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS family
  FROM (SELECT DISTINCT line, doc_id FROM lines) GROUP BY 1 HAVING count(*) > 1) GROUP BY family""")
def clone_families(t, spark, d):
    return clones.clone_families(lines(spark, d)).drop("family")


@query("WITH " + LINES_SQL + """, g AS (SELECT line, count(DISTINCT doc_id) AS files, count(*) AS n FROM lines GROUP BY 1)
  SELECT sum(n)::BIGINT AS lines, sum(CASE WHEN files > 1 THEN n ELSE 0 END)::BIGINT AS duplicated,
  round(100 * sum(CASE WHEN files > 1 THEN n ELSE 0 END) / sum(n), 2) AS percent FROM g""")
def duplication_stats(t, spark, d):
    return clones.duplication_share(lines(spark, d))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
  k AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS h FROM w),
  g AS (SELECT h, count(*) AS c FROM k GROUP BY 1)
  SELECT doc_id, count(*) AS windows, sum(CASE WHEN c > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated FROM k JOIN g USING (h) GROUP BY 1""")
def shingle_prefilter(t, spark, d):
    return clones.repeated_windows(t("documents"), 20)


# health ---------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(pow(l_linenumber, 2) * pow(1 - l_discount, 3) + l_linenumber, 6) AS crap FROM lineitem")
def crap_scores(t, spark, d):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(metrics.crap(F.col("l_linenumber"), F.col("l_discount")), 6).alias("crap"))


@query("""SELECT event_type, sum((ts < TIMESTAMP '2024-01-16')::INT)::BIGINT AS older, sum((ts >= TIMESTAMP '2024-01-16')::INT)::BIGINT AS recent,
  CASE WHEN sum((ts < TIMESTAMP '2024-01-16')::INT) = 0 OR sum((ts >= TIMESTAMP '2024-01-16')::INT) / sum((ts < TIMESTAMP '2024-01-16')::INT) > 1.5 THEN 'accelerating'
  WHEN sum((ts >= TIMESTAMP '2024-01-16')::INT) / sum((ts < TIMESTAMP '2024-01-16')::INT) < 0.67 THEN 'cooling' ELSE 'stable' END AS trend FROM events GROUP BY 1""")
def churn_trend(t, spark, d):
    return metrics.trend(t("events"), "event_type", "ts", "2024-01-16 00:00:00")


@query("""SELECT user_id, round(sum(pow(0.5, date_diff('day', ts::DATE, DATE '2024-01-31') / 90)), 6) AS weight FROM events GROUP BY 1""")
def recency_weighted_churn(t, spark, d):
    return metrics.recency_weight(t("events"), "user_id", "ts", "2024-01-31")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS p FROM lineitem), s AS (SELECT * FROM c WHERE k IN (SELECT k FROM c GROUP BY 1 HAVING count(*) <= 50)),
  r AS (SELECT p, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5),
  x AS (SELECT a.p AS a, b.p AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT a, b, shared, round(2 * shared / (ra.n + rb.n), 2) AS degree FROM x JOIN r ra ON a = ra.p JOIN r rb ON b = rb.p WHERE (a + b) % 3 <> 0""")
def change_coupling(t, spark, d):
    changes = t("lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("path"))
    return metrics.change_coupling(changes, (F.col("a") + F.col("b")) % 3 == 0)


@query("""WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey) AS total, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS rank FROM n),
  c AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey ORDER BY rank) - n AS before FROM r)
  SELECT l_partkey, max(CASE WHEN rank = 1 THEN l_suppkey END) AS top, max(CASE WHEN rank = 1 THEN round(n / total, 4) END) AS share, count(*) AS authors,
  sum(CASE WHEN 2 * before < total THEN 1 ELSE 0 END)::BIGINT AS bus_factor FROM c GROUP BY 1""")
def ownership(t, spark, d):
    return metrics.ownership(t("lineitem"), "l_partkey", "l_suppkey")


@query("""WITH f AS (SELECT l_partkey, count(*) AS churn, sum(l_linenumber)::BIGINT AS complexity FROM lineitem GROUP BY 1)
  SELECT l_partkey, round(100 * churn / (SELECT max(churn) FROM f) * complexity / (SELECT max(complexity) FROM f), 2) AS score FROM f""")
def hotspots(t, spark, d):
    f = t("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("churn"), F.sum("l_linenumber").alias("complexity"))
    return metrics.hotspots(f, "l_partkey", "churn", "complexity")


@query("""SELECT count(*) AS files, sum((doc_id IN (SELECT doc_id FROM labels))::INT)::BIGINT AS covered,
  round(100 * sum((doc_id IN (SELECT doc_id FROM labels))::INT) / count(*), 1) AS percent FROM documents""")
def coverage_summary(t, spark, d):
    labels = t("labels").select("doc_id").distinct().withColumn("hit", F.lit(1))
    return metrics.coverage_summary(t("documents").select("doc_id").join(labels, "doc_id", "left"), F.col("hit").isNotNull())


@query("""WITH q AS (SELECT l_partkey AS k, l_quantity AS v, l_shipdate < TIMESTAMP '1995-06-01' AS old FROM lineitem),
  b AS (SELECT k, sum(v) AS b FROM q WHERE old GROUP BY 1), h AS (SELECT k, sum(v) AS h FROM q WHERE NOT old GROUP BY 1)
  SELECT k, CASE WHEN b IS NULL THEN 'introduced' WHEN h IS NULL THEN 'fixed' WHEN h > b THEN 'worsened' WHEN h < b THEN 'improved' ELSE 'inherited' END AS state
  FROM b FULL JOIN h USING (k)""")
def audit_states(t, spark, d):
    q = t("lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("q"), (F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp")).alias("old"))
    sides = [q.filter(f).groupBy("k").agg(F.sum("q").alias("v")) for f in (F.col("old"), ~F.col("old"))]
    return metrics.compare_snapshots(*sides, "k", "v")


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority,
  substr(sha256(o_orderkey::VARCHAR), 1, 16), o_orderkey) AS r FROM orders) WHERE r <= 2""")
def sampled_mutants(t, spark, d):
    return metrics.sample_per_group(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey"], F.col("o_orderpriority"), "o_orderkey", 2).select("o_orderkey", "o_custkey")


@query("""SELECT event_id, user_id FROM events WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND event_id % 1000 BETWEEN c_nationkey * 10 AND c_nationkey * 10 + 60)""")
def findings_in_diff(t, spark, d):
    points = t("events").select("event_id", F.col("user_id").alias("file"), (F.col("event_id") % 1000).alias("line"))
    ranges = t("customer").select(F.col("c_custkey").alias("file"), (F.col("c_nationkey") * 10).cast("long").alias("first"), (F.col("c_nationkey") * 10 + 60).cast("long").alias("last"))
    return metrics.within_ranges(points, ranges).select("event_id", F.col("file").alias("user_id"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0 AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def similar_code(t, spark, d):
    v = t("embeddings")
    return metrics.similar_search(v.filter("vec_id % 100 = 0"), v, "vec_id", "embedding", 0.3)


@query("""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def similar_code_pairs(t, spark, d):
    return metrics.similar_pairs(t("embeddings"), "vec_id", "embedding", 0.3)


# findings -------------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, href, count(*) AS sites FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def template_links(t, spark, d):
    return t("pages").select("page_id", F.explode_outer(T.links(F.col("html"))).alias("href")).filter("href IS NOT NULL").groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("sites"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
  CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/en/[^/]*$') AND NOT regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/en/[^/]*\\.html$')
  THEN true ELSE false END AS ignored FROM pages""".replace("\\\\", "\\"))
def ignore_patterns(t, spark, d):
    path = T.url_path(F.col("url"))
    return t("pages").select("page_id", T.host(F.col("url")).alias("host"), path.alias("path"), T.matches_globs(path, ["/en/*", "!/en/*.html"]).alias("ignored"))


@query("""SELECT l_orderkey AS fn, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS cyclomatic, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS cognitive FROM lineitem GROUP BY 1""")
def complexity_totals(t, spark, d):
    metric = F.when(F.col("l_returnflag") == "R", "cyclomatic").otherwise("cognitive").alias("metric")
    return health.complexity_units(t("lineitem").select(F.col("l_orderkey").alias("fn"), metric, F.col("l_quantity").alias("weight")))


@query("""SELECT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' EXCEPT ALL
  SELECT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'""")
def baseline_multiset(t, spark, d):
    line, new = t("lineitem"), F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")
    return results.head_minus_base(line.filter(new), line.filter(~new), ["l_partkey", "l_suppkey"])


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, o_custkey ORDER BY o_orderkey) AS place FROM orders)
  SELECT o_orderkey, sha256(concat_ws('|', o_orderstatus, o_orderpriority, o_custkey::VARCHAR, place::VARCHAR)) AS finding_id FROM p""")
def stable_ids(t, spark, d):
    found = t("orders").withColumn("hidden", F.lit(False))
    return security.stable_ids(found, ["o_orderstatus", "o_orderpriority", "o_custkey"], ["o_orderkey"], "hidden").select("o_orderkey", "finding_id")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 450000 OR o_orderpriority LIKE '1%' OR o_orderstatus = 'F' AND o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderstatus = 'F' OR o_orderpriority LIKE '3%' THEN 'medium' ELSE 'low' END AS tier FROM orders""")
def severity_tiers(t, spark, d):
    prio = lambda k: F.col("o_orderpriority").startswith(k)
    tier = security.severity(F.col("o_totalprice") > 450000, prio("1"), prio("2"), F.col("o_orderstatus") == "F", prio("3"))
    return t("orders").select("o_orderkey", tier.alias("tier"))


@query("""SELECT json_extract_string(props, '$.k') AS key, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) AS reads, min(event_id) AS first_site FROM events GROUP BY 1""")
def feature_flags(t, spark, d):
    return extensions.flag_inventory(t("events").select(F.col("event_id").alias("site"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("key")))


@query("""SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_history(t, spark, d):
    return history.daily_counts(t("events")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")
