"""Queries of the resolution operators: orders import parts as modules, pages are paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import resolution as R
from .registry import query

PATHS_SQL = """paths AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)"""


def paths(t):
    return t("pages").select(F.concat(T.host(F.col("url")), T.url_path(F.col("url"))).alias("path")).distinct()


def module_imports(t):
    file = F.concat(F.lit("m"), F.col("l_suppkey") % 5, F.lit("/f"), F.col("l_orderkey"), F.lit(".ts"))
    source = F.concat(F.lit("../m"), F.col("l_suppkey") % 3, F.lit("/./p"), F.col("l_partkey"), F.when(F.col("l_linenumber") == 1, "?raw").otherwise(""))
    return t("lineitem").select(file.alias("file"), source.alias("source"))


def module_files(t):
    end = F.when(F.col("p_size") % 3 == 0, ".ts").when(F.col("p_size") % 3 == 1, "/index.js").otherwise(".css")
    return t("part").select(F.concat(F.lit("m"), F.col("p_partkey") % 3, F.lit("/p"), F.col("p_partkey"), end).alias("path"))


MODULES_SQL = """i AS (SELECT 'm' || (l_suppkey % 5) || '/f' || l_orderkey || '.ts' AS file,
  '../m' || (l_suppkey % 3) || '/./p' || l_partkey || CASE WHEN l_linenumber = 1 THEN '?raw' ELSE '' END AS source, l_suppkey % 3 AS m, l_partkey AS p FROM lineitem),
  f AS (SELECT p_partkey AS p, p_partkey % 3 AS m, 'm' || (p_partkey % 3) || '/p' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.ts' ELSE '/index.js' END AS target,
  CASE p_size % 3 WHEN 0 THEN 'extension' ELSE 'index' END AS strategy FROM part WHERE p_size % 3 < 2)"""


@query(f"WITH {MODULES_SQL} SELECT file, source, target, strategy FROM i LEFT JOIN f USING (p, m)")
def resolved_imports(t, spark, d):
    return R.resolve(module_imports(t), module_files(t))


@query(f"WITH {MODULES_SQL} SELECT source, count(*) AS sites FROM i LEFT JOIN f USING (p, m) WHERE target IS NULL AND source NOT LIKE '../m0%' GROUP BY 1")
def unresolved_imports(t, spark, d):
    return R.unresolved_sites(module_imports(t), module_files(t), ["../m0"])


@query(f"""WITH {PATHS_SQL}, r AS (SELECT DISTINCT root FROM (SELECT string_split(path, '/')[1] AS root FROM paths UNION SELECT string_split(path, '/')[1] || '/en' FROM paths))
  SELECT path, arg_max(root, length(root)) AS root FROM paths JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY 1""")
def workspace_owners(t, spark, d):
    host = F.substring_index("path", "/", 1)
    p = paths(t)
    return R.owners(p, p.select(F.explode(F.array(host, F.concat(host, F.lit("/en")))).alias("root")))


@query("""WITH i AS (SELECT DISTINCT p_type || '/' || p_brand || '/' || p_partkey AS source FROM part),
  a AS (SELECT p_type AS prefix, 'src/' || lower(p_type) AS target FROM part UNION SELECT p_type || '/' || p_brand, 'lib' FROM part WHERE p_size > 45)
  SELECT source, arg_max(target || substr(source, length(prefix) + 1), length(prefix)) AS aliased FROM i JOIN a ON starts_with(source, prefix || '/') GROUP BY 1""")
def aliased_imports(t, spark, d):
    part = t("part")
    source = part.select(F.concat_ws("/", "p_type", "p_brand", "p_partkey").alias("source"))
    short = part.select(F.col("p_type").alias("prefix"), F.concat(F.lit("src/"), F.lower("p_type")).alias("target"))
    long = part.filter("p_size > 45").select(F.concat_ws("/", "p_type", "p_brand").alias("prefix"), F.lit("lib").alias("target"))
    return R.apply_aliases(source, short.unionByName(long).distinct())


@query(f"""WITH {PATHS_SQL}, g AS (SELECT DISTINCT string_split(path, '/')[1] AS host FROM paths)
  SELECT host AS file, path FROM g JOIN paths ON starts_with(path, host || '/en/') AND ends_with(path, '1') AND length(path) >= length(host) + 5""")
def pattern_imports(t, spark, d):
    p = paths(t)
    host = F.substring_index("path", "/", 1)
    return R.pattern_imports(p.select(host.alias("file"), F.concat(host, F.lit("/en/")).alias("prefix"), F.lit("1").alias("suffix")).distinct(), p)


@query("""SELECT p_brand AS package, './' || p_size || '/x' AS subpath, CASE WHEN p_size % 2 = 0 THEN 'dist/even.js' WHEN p_size = 7 THEN NULL ELSE 'dist/' || p_size || '.mjs' END AS target
  FROM part GROUP BY p_brand, p_size""")
def package_exports(t, spark, d):
    part = t("part").select("p_brand", "p_size").distinct()
    rules = [(F.lit("./*/x"), 1, "import", F.lit("dist/*.mjs")), (F.lit("./*/x"), 0, "browser", F.lit("no.js")), (F.lit("./7/x"), 0, "import", F.lit(None).cast("string"))]
    rows = [part.select(F.col("p_brand").alias("package"), k.alias("key"), F.lit(o).alias("ordinal"), F.lit(c).alias("condition"), to.alias("target")) for k, o, c, to in rules]
    even = part.filter("p_size % 2 = 0").select(F.col("p_brand").alias("package"), F.concat(F.lit("./"), "p_size", F.lit("/x")).alias("key"), F.lit(0).alias("ordinal"), F.lit("import").alias("condition"), F.lit("dist/even.js").alias("target"))
    exports = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(even).distinct()
    return R.export_targets(part.select(F.col("p_brand").alias("package"), F.concat(F.lit("./"), "p_size", F.lit("/x")).alias("subpath")), exports, ["import", "default"])


@query("""WITH s AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN '@' || lower(p_type) || '/kit/sub' WHEN 1 THEN lower(p_type) || '/deep/file' WHEN 2 THEN './' || p_partkey ELSE 'node:fs' END AS source, p_brand AS file FROM part)
  SELECT CASE WHEN source LIKE '@%' THEN regexp_extract(source, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(source, '^([^/]+)', 1) END AS package, count(DISTINCT file) AS files
  FROM s WHERE source NOT LIKE './%' AND source NOT LIKE 'node:%' GROUP BY 1""")
def package_usage(t, spark, d):
    kind = F.col("p_size") % 4
    source = F.when(kind == 0, F.concat(F.lit("@"), F.lower("p_type"), F.lit("/kit/sub"))).when(kind == 1, F.concat(F.lower("p_type"), F.lit("/deep/file")))
    source = source.when(kind == 2, F.concat(F.lit("./"), "p_partkey")).otherwise("node:fs")
    used = R.package_usage(t("part").select(source.alias("source"), F.col("p_brand").alias("file")))
    return used.groupBy("package").agg(F.count(F.lit(1)).alias("files"))
