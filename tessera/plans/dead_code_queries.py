"""Queries of unused code and dependencies on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dead_code, dependencies
from ..sources.facts import DEPS_SQL, EXPORTS_SQL, PAIRS_SQL, REFS_SQL, deps, exports, pairs, refs, uses
from .registry import query


def members(t, *kinds):
    return pairs(t, *kinds).select("owner", F.col("name").alias("member")).distinct()


@query("WITH RECURSIVE " + PAIRS_SQL + """, e AS (SELECT DISTINCT owner AS src, name AS dst FROM pairs WHERE kind <> 'view'),
  f AS (SELECT c_custkey AS file, c_acctbal > 9000 AS is_entry, c_acctbal BETWEEN 0 AND 500 AS is_config, c_mktsegment = 'BUILDING' AS is_page, c_acctbal < 8900 AS exists_, c_acctbal < -500 AS suppressed FROM customer),
  r AS (SELECT file AS node FROM f WHERE is_entry UNION SELECT dst FROM r JOIN e ON node = src),
  k AS (SELECT node AS file FROM r UNION SELECT dst FROM e WHERE src IN (SELECT node FROM r) UNION SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT node FROM r)
    UNION SELECT owner FROM pairs WHERE kind = 'view' AND name IN (SELECT node FROM r))
  SELECT file, suppressed FROM f WHERE NOT is_entry AND NOT is_config AND NOT is_page AND exists_ AND file NOT IN (SELECT file FROM k)""")
def unused_files(t, spark, d):
    files = t("customer").selectExpr("c_custkey AS file", "c_acctbal > 9000 AS is_entry", "c_acctbal BETWEEN 0 AND 500 AS is_config", "c_mktsegment = 'BUILDING' AS is_page", "c_acctbal < 8900 AS exists", "c_acctbal < -500 AS suppressed")
    edges = pairs(t).filter("kind <> 'view'").selectExpr("owner AS src", "name AS dst").distinct()
    refs = t("supplier").selectExpr("cast(s_nationkey AS long) AS from_file", "s_suppkey AS file")
    return dead_code.unused_files(files, edges, refs, pairs(t, "view").selectExpr("owner AS file", "name AS source"))


@query("WITH " + EXPORTS_SQL + ", " + REFS_SQL + """, c AS (SELECT item_id AS export FROM benchmark), y AS (SELECT page_id AS export FROM pages)
  SELECT export, CASE WHEN is_type THEN 'unused-type' ELSE 'unused-export' END AS rule FROM exports WHERE NOT suppressed AND export NOT IN (SELECT export FROM refs)
  AND export NOT IN (SELECT export FROM c) AND NOT (is_type AND export IN (SELECT export FROM y))""")
def unused_exports(t, spark, d):
    return dead_code.unused_exports(exports(t), refs(t), t("benchmark").select(F.col("item_id").alias("export")), t("pages").select(F.col("page_id").alias("export")))


@query("WITH " + EXPORTS_SQL + ", " + REFS_SQL + """, u AS (SELECT * FROM exports WHERE export IN (SELECT export FROM refs)), n AS (SELECT n_name, 'src' || n_nationkey AS source, 'src' || n_regionkey AS file FROM nation)
  SELECT export, 'star-entry' AS reason FROM exports WHERE file IN (SELECT source FROM n WHERE n_name < 'C')
  UNION SELECT export, 'condition-target' FROM exports WHERE file IN (SELECT 'src' || r_regionkey FROM region)
  UNION SELECT x.export, 'declaration-sibling' FROM exports x JOIN u USING (file, name) WHERE x.export <> u.export
  UNION SELECT x.export, 'manual-mock' FROM exports x JOIN n ON x.file = n.file JOIN u ON u.file = n.source AND u.name = x.name""")
def export_credits(t, spark, d):
    n = t("nation").selectExpr("n_name", "concat('src', n_nationkey) AS source", "concat('src', n_regionkey) AS file")
    targets = t("region").selectExpr("concat('src', r_regionkey) AS file")
    return dead_code.export_credits(exports(t), refs(t), n.filter("n_name < 'C'").select("file", "source"), targets, n.select("file", F.col("source").alias("of")))


@query("WITH " + EXPORTS_SQL + ", " + REFS_SQL + """ SELECT export, count(*) AS uses, string_agg(DISTINCT from_file, ',' ORDER BY from_file) AS files, min(refs.line) AS first_line
  FROM refs JOIN exports USING (export) WHERE deprecated AND from_file IN ('label', 'user', 'system') GROUP BY 1""")
def deprecated_exports_in_use(t, spark, d):
    live = spark.createDataFrame([("label",), ("user",), ("system",)], "file string")
    return dead_code.deprecated_in_use(exports(t), refs(t), live)


@query("""SELECT DISTINCT s.source AS file, doc_id AS export, s.lang AS type FROM documents s JOIN (SELECT source, lang FROM documents GROUP BY 1, 2 HAVING NOT bool_or(n_chars > 9000)) t ON s.source = t.source AND s.lang = t.lang""")
def private_type_leaks(t, spark, d):
    s = t("documents").selectExpr("source AS file", "doc_id AS export", "lang AS type", "n_chars > 9000 AS exported")
    return dead_code.private_type_leaks(s, s)


@query("WITH RECURSIVE " + PAIRS_SQL + """, h AS (SELECT DISTINCT owner AS class, name AS base FROM pairs WHERE kind = 'error' AND owner > name), s AS (SELECT base, class FROM h UNION SELECT s.base, h.class FROM s JOIN h ON h.base = s.class),
  a AS (SELECT owner, name AS member FROM pairs WHERE kind = 'click' AND owner >= 50), i AS (SELECT * FROM a UNION SELECT class, member FROM a JOIN s ON base = owner WHERE owner >= 90 UNION SELECT base, member FROM a JOIN s ON class = owner WHERE owner >= 90),
  p AS (SELECT o_orderkey AS member FROM orders WHERE o_orderstatus = 'P'), m AS (SELECT owner, name AS member FROM pairs WHERE kind = 'signup')
  SELECT owner, member FROM m WHERE (owner, member) NOT IN (SELECT owner, member FROM i) AND (owner, member) NOT IN (SELECT owner, member FROM a) AND member NOT IN (SELECT member FROM p)""")
def unused_members(t, spark, d):
    heritage = pairs(t, "error").filter("owner > name").selectExpr("owner AS class", "name AS base")
    accesses, declared = members(t, "click").filter("owner >= 50"), members(t, "signup")
    far = dead_code.inherited_accesses(accesses.filter("owner >= 90"), heritage)
    probed = dead_code.probed_members(declared, t("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("member")))
    return dead_code.unused_members(declared, accesses.unionByName(far).unionByName(probed))


#: names of members by number: those that frameworks call, and each with a mark behind it, which they don't
NAMES = [n + mark for names in dead_code.LIFECYCLE.values() for n in names for mark in ("", "2")]
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


@query(f"""WITH m AS (SELECT DISTINCT user_id AS owner, ({NAMES_SQL})[event_id % {len(NAMES)} + 1] AS member FROM events WHERE event_type = 'signup'), a AS (SELECT user_id AS owner, ({NAMES_SQL})[event_id % {len(NAMES)} + 1] AS member FROM events WHERE event_type = 'click'),
  l AS (SELECT 'angular' AS framework, unnest({str(dead_code.LIFECYCLE["angular"])}) AS name UNION ALL SELECT 'react', unnest({str(dead_code.LIFECYCLE["react"])}))
  SELECT f AS framework, owner, member FROM m, (VALUES ('angular'), ('react')) v(f) WHERE (owner, member) NOT IN (SELECT owner, member FROM a) AND (f, member) NOT IN (SELECT framework, name FROM l)""")
def unused_members_of_frameworks(t, spark, d):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int")).alias("member")
    of = lambda kind: t("events").filter(F.col("event_type") == kind).select(F.col("user_id").alias("owner"), name).distinct()
    every = [dead_code.unused_members(of("signup"), of("click"), f).select(F.lit(f).alias("framework"), "owner", "member") for f in dead_code.LIFECYCLE]
    return every[0].unionByName(every[1])


@query("WITH " + PAIRS_SQL + """ SELECT DISTINCT b.owner AS owner, a.name AS member FROM pairs a JOIN (SELECT owner AS holder, name AS prop, name + 1 AS owner FROM pairs WHERE kind = 'view') b ON a.owner = b.holder AND a.name = b.prop WHERE a.kind = 'click'""")
def typed_property_accesses(t, spark, d):
    props = pairs(t, "view").selectExpr("owner AS holder", "name AS prop", "name + 1 AS owner")
    return dead_code.typed_accesses(props, pairs(t, "click").selectExpr("owner AS holder", "name AS prop", "name AS member"))


@query("SELECT DISTINCT o_custkey AS owner, x AS member FROM (SELECT o_custkey, unnest(string_split(o_orderpriority, '-')) AS x FROM orders)")
def fluent_chain_accesses(t, spark, d):
    return dead_code.fluent_accesses(t("orders").select(F.col("o_custkey").alias("owner"), F.split("o_orderpriority", "-").alias("path")))


@query("WITH " + PAIRS_SQL + """ SELECT DISTINCT owner AS src, name AS dst FROM pairs WHERE owner IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND name IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def production_excluded_imports(t, spark, d):
    files = t("customer").withColumnRenamed("c_custkey", "file")
    return dead_code.production_excluded(pairs(t).selectExpr("owner AS src", "name AS dst"), files.filter("c_mktsegment = 'MACHINERY'"), files.filter("c_acctbal > 0"))


@query("WITH " + EXPORTS_SQL + " SELECT export, file, name FROM exports WHERE file NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def off_public_surface(t, spark, d):
    public = t("nation").filter("n_regionkey = 1").selectExpr("concat('src', n_nationkey) AS file")
    return dead_code.off_public_surface(exports(t).select("export", "file", "name"), public)


@query("""WITH m AS (SELECT o_orderpriority AS rule, count(*) AS m FROM orders WHERE o_orderpriority < '4' GROUP BY 1), n AS (SELECT o_orderpriority AS rule, count(*) AS n FROM orders WHERE o_orderpriority < '3' AND o_orderstatus = 'P' GROUP BY 1)
  SELECT r.rule, coalesce(n, 0) AS findings, CASE WHEN n > 0 THEN 'findings' WHEN m > 0 THEN 'clean' ELSE 'unconfigured' END AS status FROM (SELECT DISTINCT o_orderpriority AS rule FROM orders) r LEFT JOIN m USING (rule) LEFT JOIN n USING (rule)""")
def check_status(t, spark, d):
    o = t("orders").withColumnRenamed("o_orderpriority", "rule")
    return dead_code.check_status(o, o.filter("rule < '4'"), o.filter("rule < '3' AND o_orderstatus = 'P'"))


@query("WITH " + EXPORTS_SQL + """ SELECT export, coalesce(action, 'edit') AS action FROM exports LEFT JOIN (SELECT 'src' || n_nationkey AS file, min(n_name) AS action FROM nation WHERE n_regionkey < 2 GROUP BY 1) USING (file)""")
def export_actions(t, spark, d):
    hints = t("nation").filter("n_regionkey < 2").selectExpr("concat('src', n_nationkey) AS file", "n_name AS action")
    return dead_code.export_actions(exports(t), hints)


@query("WITH " + DEPS_SQL + """ SELECT DISTINCT workspace, name, CASE kind WHEN 'prod' THEN 'unused-dependency' WHEN 'dev' THEN 'unused-dev-dependency' ELSE 'unused-optional-dependency' END AS rule
  FROM deps WHERE kind <> 'peer' AND name NOT IN (SELECT name FROM uses) AND name NOT IN (SELECT doc_id FROM documents)""")
def unused_dependencies(t, spark, d):
    return dependencies.unused_dependencies(deps(t), uses(t), t("documents").select(F.col("doc_id").alias("name")))


@query("""WITH u AS (SELECT c_nationkey AS workspace, l_partkey % 50 AS name, l_suppkey AS site FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  k AS (SELECT c_nationkey AS workspace, l_partkey % 50 AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 48 UNION SELECT s_nationkey, s_suppkey FROM supplier)
  SELECT workspace, name, count(*) AS uses, string_agg(DISTINCT site::VARCHAR, ',' ORDER BY site) AS sites FROM (SELECT u.* FROM u LEFT JOIN k USING (workspace, name) WHERE k.name IS NULL) GROUP BY 1, 2""".replace("string_agg(DISTINCT site::VARCHAR, ',' ORDER BY site)", "array_to_string(list_sort(list(DISTINCT site)), ',')"))
def unlisted_dependencies_of_workspaces(t, spark, d):
    u = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    listed = u.filter("l_quantity > 48").selectExpr("c_nationkey AS workspace", "l_partkey % 50 AS name")
    ignored = t("supplier").selectExpr("s_nationkey AS workspace", "s_suppkey AS name")
    return dependencies.unlisted_dependencies(u.selectExpr("c_nationkey AS workspace", "l_partkey % 50 AS name", "l_suppkey AS site"), listed, ignored)


@query("""WITH s AS (SELECT DISTINCT o_custkey AS workspace, o_orderpriority AS "binary" FROM orders), k AS (SELECT DISTINCT c_custkey AS workspace, o_orderpriority AS "binary" FROM customer JOIN (SELECT DISTINCT o_custkey % 25 AS name, o_orderpriority FROM orders WHERE o_totalprice > 495000) p ON c_nationkey = name)
  SELECT s.* FROM s LEFT JOIN k USING (workspace, "binary") WHERE k.workspace IS NULL AND "binary" <> '1-URGENT'""")
def unlisted_binaries(t, spark, d):
    scripts = t("orders").selectExpr("o_custkey AS workspace", "o_orderpriority AS binary")
    provided = t("orders").filter("o_totalprice > 495000").selectExpr("o_custkey % 25 AS name", "o_orderpriority AS binary").distinct()
    return dependencies.unlisted_binaries(scripts, provided, t("customer").selectExpr("c_custkey AS workspace", "cast(c_nationkey AS long) AS name"), ["1-URGENT"])


@query("WITH " + DEPS_SQL + """ SELECT name, 'type-only-dependency' AS rule FROM (SELECT name FROM uses GROUP BY 1 HAVING bool_and(type_only)) WHERE name IN (SELECT name FROM deps WHERE kind = 'prod')""")
def type_only_dependencies(t, spark, d):
    return dependencies.narrow_dependencies(deps(t), uses(t), production=True)


@query("WITH " + DEPS_SQL + """ SELECT name, 'test-only-dependency' AS rule FROM (SELECT name FROM uses GROUP BY 1 HAVING bool_and(is_test)) WHERE name IN (SELECT name FROM deps WHERE kind = 'prod')""")
def test_only_dependencies(t, spark, d):
    return dependencies.narrow_dependencies(deps(t), uses(t), production=False)


@query("WITH " + DEPS_SQL + """ SELECT workspace, name, count(DISTINCT file) AS files FROM (SELECT workspace, name FROM deps GROUP BY 1, 2 HAVING bool_and(kind = 'dev')) JOIN uses USING (name) WHERE NOT type_only AND NOT is_test GROUP BY 1, 2""")
def dev_dependencies_in_production(t, spark, d):
    return dependencies.dev_in_production(deps(t), uses(t))


@query("""WITH o AS (SELECT DISTINCT p_partkey AS name, CASE WHEN p_size < 10 THEN '^1.' || p_size WHEN p_size < 20 THEN 'latest' WHEN p_size < 30 THEN 'npm:x@1' WHEN p_size < 40 THEN '??' ELSE NULL END AS spec, p_size FROM part)
  SELECT name, 'misconfigured-dependency-override' AS rule FROM o WHERE p_size >= 30 UNION SELECT name, 'unused-dependency-override' FROM o WHERE p_size < 30 AND name NOT IN (SELECT page_id FROM pages)""")
def override_findings(t, spark, d):
    spec = "CASE WHEN p_size < 10 THEN concat('^1.', p_size) WHEN p_size < 20 THEN 'latest' WHEN p_size < 30 THEN 'npm:x@1' WHEN p_size < 40 THEN '??' END AS spec"
    return dependencies.override_findings(t("part").selectExpr("p_partkey AS name", spec), t("pages").select(F.col("page_id").alias("name")))


@query("""SELECT CASE WHEN p_name LIKE 'small%' THEN 'pkg-small' WHEN p_name LIKE 'sm%' THEN 'pkg-sm' WHEN p_name LIKE 'red%' THEN 'pkg-red' ELSE 'pkg-b' END AS package, count(*) AS names
  FROM (SELECT DISTINCT p_name FROM part WHERE p_name LIKE 'sm%' OR p_name LIKE 'red%' OR p_name LIKE 'b%') GROUP BY 1""")
def convention_uses(t, spark, d):
    rules = spark.createDataFrame([("small", "pkg-small"), ("sm", "pkg-sm"), ("red", "pkg-red"), ("b", "pkg-b")], "prefix string, package string")
    return dependencies.convention_uses(t("part").select(F.col("p_name").alias("name")), rules)


@query("""WITH e AS (SELECT DISTINCT p_brand AS g, p_name AS name FROM part WHERE p_type = 'SMALL' AND p_brand < 'Brand#8'), r AS (SELECT DISTINCT p_brand AS g, p_name AS name FROM part WHERE p_type = 'LARGE')
  SELECT g AS "group", name, 'unused-catalog-entry' AS rule FROM (SELECT * FROM e EXCEPT SELECT * FROM r) UNION ALL SELECT g, name, 'unresolved-catalog-reference' FROM (SELECT * FROM r EXCEPT SELECT * FROM e)
  UNION ALL SELECT DISTINCT p_brand, NULL, 'empty-catalog-group' FROM part WHERE p_brand NOT IN (SELECT g FROM e)""")
def catalog_findings(t, spark, d):
    p = t("part").select(F.col("p_brand").alias("group"), F.col("p_name").alias("name"), "p_type")
    return dependencies.catalog_findings(p, p.filter("p_type = 'SMALL' AND group < 'Brand#8'"), p.filter("p_type = 'LARGE'"))
