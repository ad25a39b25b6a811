"""Queries of the further ways to look up a specifier, on paths made of parts and suppliers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolution as R
from .registry import query

FILES_SQL = """files AS (SELECT DISTINCT 'pkg' || (p_size % 5) || '/src/' || p_type || '/' || split_part(p_name, ' ', 2) || CASE WHEN p_size < 25 THEN '.ts' WHEN p_size < 40 THEN '.scss' ELSE '.svg' END AS path FROM part),
  asked AS (SELECT DISTINCT 'pkg' || (l_suppkey % 5) || '/src/' || p_type || '/f' || l_linenumber || '.ts' AS file, p_type || '/' || split_part(p_name, ' ', 2) AS source, p_type AS dir, split_part(p_name, ' ', 2) AS name, l_suppkey % 5 AS own, p_size % 5 AS pkg FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def files(t):
    end = "CASE WHEN p_size < 25 THEN '.ts' WHEN p_size < 40 THEN '.scss' ELSE '.svg' END"
    return t("part").selectExpr(f"concat('pkg', p_size % 5, '/src/', p_type, '/', split_part(p_name, ' ', 2), {end}) AS path").distinct()


def asked(t):
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.selectExpr("concat('pkg', l_suppkey % 5, '/src/', p_type, '/f', l_linenumber, '.ts') AS file", "concat(p_type, '/', split_part(p_name, ' ', 2)) AS source",
                        "split_part(p_name, ' ', 2) AS name", "p_type AS dir", "l_suppkey % 5 AS own", "p_size % 5 AS pkg").distinct()


@query("WITH " + FILES_SQL + """ SELECT DISTINCT file, 'import' AS condition, 'pkg1/src/' || source || '.ts' AS target FROM asked WHERE 'pkg1/src/' || source || '.ts' IN (SELECT path FROM files)
  UNION SELECT DISTINCT file, 'style', 'pkg2/src/' || source || '.scss' FROM asked WHERE 'pkg2/src/' || source || '.scss' IN (SELECT path FROM files)""")
def all_condition_edges(t, spark, d):
    known = asked(t).select("source").distinct()
    rows = known.selectExpr("source AS key", "'import' AS condition", "concat('./pkg1/src/', source, '.ts') AS target").union(known.selectExpr("source", "'style'", "concat('pkg2/x/../src/', source, '.scss')"))
    return R.condition_edges(asked(t), rows, files(t))


@query("WITH " + FILES_SQL + " SELECT DISTINCT file, source, 'pkg' || own || '/src/' || source || '.ts' AS target FROM asked WHERE 'pkg' || own || '/src/' || source || '.ts' IN (SELECT path FROM files)")
def package_root_sources(t, spark, d):
    roots = spark.createDataFrame([(f"pkg{i}",) for i in range(5)], "root string")
    return R.in_package_root(asked(t).select("file", "source").distinct(), roots, files(t))


@query("WITH " + FILES_SQL + """, c AS (SELECT DISTINCT file, source, 'pkg' || p || '/src/' || source || '.scss' AS target, r FROM asked, (VALUES (3, 1), (1, 2)) v(p, r))
  SELECT file, source, arg_min(target, r) AS target FROM c WHERE target IN (SELECT path FROM files) GROUP BY 1, 2""")
def stylesheet_imports(t, spark, d):
    return R.stylesheet_targets(asked(t).select("file", "source").distinct(), ["pkg3/src", "pkg1/src"], files(t))


@query("WITH " + FILES_SQL + " SELECT DISTINCT file, '@w/p' || pkg || '/' || source AS source, 'pkg' || pkg || '/src/' || source || '.ts' AS target FROM asked WHERE 'pkg' || pkg || '/src/' || source || '.ts' IN (SELECT path FROM files)")
def workspace_aliases(t, spark, d):
    a = asked(t).selectExpr("file", "concat('@w/p', pkg, '/', source) AS source").distinct()
    return R.workspace_targets(a, spark.createDataFrame([(f"@w/p{i}", f"pkg{i}/src") for i in range(5)], "package string, root string"), files(t))


@query("WITH " + FILES_SQL + " SELECT DISTINCT file, '@w/p' || pkg || '/' || source || '.svg' AS source, 'pkg' || pkg || '/src/' || source || '.svg' AS target FROM asked WHERE 'pkg' || pkg || '/src/' || source || '.svg' IN (SELECT path FROM files)")
def package_assets(t, spark, d):
    a = asked(t).selectExpr("file", "concat('@w/p', pkg, '/', source, '.svg') AS source").distinct()
    return R.workspace_targets(a, spark.createDataFrame([(f"@w/p{i}", f"pkg{i}/src") for i in range(5)], "package string, root string"), files(t), assets=True)


@query("WITH " + FILES_SQL + " SELECT DISTINCT file, source FROM asked WHERE dir IN (SELECT split_part(path, '/', 3) FROM files WHERE path LIKE 'pkg1/src/%')")
def base_url_folders(t, spark, d):
    return R.base_url_folders(asked(t).select("file", "source").distinct(), "pkg1/src", files(t))


@query("WITH " + FILES_SQL + """ SELECT path, CASE WHEN path LIKE 'pkg1/src/%' AND path NOT LIKE '%/SMALL/%' THEN 'one' WHEN path LIKE 'pkg1/%' AND path LIKE '%.ts' THEN 'ts' ELSE 'root' END AS config FROM files""")
def config_scopes(t, spark, d):
    configs = spark.createDataFrame([("root", "", None, None), ("ts", "pkg1", r"\.ts$", None), ("one", "pkg1/src", None, "^SMALL/")], "config string, root string, include string, exclude string")
    return R.config_scopes(files(t), configs)


@query("WITH " + FILES_SQL + """, k AS (SELECT path, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS name, CASE WHEN path LIKE 'pkg2/src/SMALL/%' THEN 0 ELSE 1 END AS r FROM files WHERE path LIKE 'pkg2/src/SMALL/%' OR path LIKE 'pkg1/src/LARGE/%')
  SELECT file, name, arg_min(path, (r, path)) AS target FROM (SELECT DISTINCT file, name FROM asked) JOIN k USING (name) GROUP BY 1, 2""")
def auto_import_edges(t, spark, d):
    return R.auto_imports(asked(t), files(t), ["pkg2/src/SMALL", "pkg1/src/LARGE"])


@query("WITH " + FILES_SQL + " SELECT path AS file, CASE WHEN path LIKE 'pkg1/%' THEN 'preact' ELSE 'react' END || '/jsx-runtime' AS package FROM files WHERE path LIKE '%.ts'")
def jsx_runtime_edges(t, spark, d):
    runtime = spark.createDataFrame([("", "react"), ("pkg1", "preact")], "root string, package string")
    return R.runtime_edges(files(t).withColumn("uses_markup", F.col("path").endswith(".ts")), runtime)


@query("WITH " + FILES_SQL + """, e AS (SELECT 'p' || n AS package, 'pkg' || n || '/src/' || x AS target, r FROM range(5) g(n), (VALUES ('SMALL/ring.ts', 1), ('LARGE/bolt.ts', 2), ('ECONOMY/gear.ts', 3)) v(x, r))
  SELECT package, arg_min(target, r) AS target FROM e WHERE target IN (SELECT path FROM files) GROUP BY 1""")
def package_entry_files(t, spark, d):
    packages = spark.createDataFrame([(f"p{i}", f"pkg{i}/src", ["./SMALL/ring.js", "LARGE/bolt", "ECONOMY/gear.ts"]) for i in range(5)], "package string, root string, entries array<string>")
    return R.package_entries(packages, files(t))


@query("WITH " + FILES_SQL + " SELECT path FROM files WHERE path NOT LIKE 'pkg1/%' AND path NOT LIKE 'pkg2/src/SMALL/%'")
def outside_project(t, spark, d):
    return R.outside_project(files(t), spark.createDataFrame([("pkg1",), ("pkg2/src/SMALL",)], "root string"))


@query("WITH " + FILES_SQL + """, o AS (SELECT DISTINCT file, name FROM asked WHERE own = 1), i AS (SELECT file, name, min(dir || '/' || name) AS target FROM asked WHERE pkg < 2 GROUP BY 1, 2)
  SELECT a.file, a.name AS child, coalesce(o.file, i.target, '-') AS target_file FROM (SELECT DISTINCT file, name FROM asked) a LEFT JOIN o USING (file, name) LEFT JOIN i USING (file, name)""")
def rendered_components(t, spark, d):
    a = asked(t)
    found = R.rendered_components(a.select("file", F.col("name").alias("child")), a.filter("own = 1"), a.filter("pkg < 2").select("file", F.col("name").alias("local"), F.concat_ws("/", "dir", "name").alias("target")))
    return found.fillna("-", ["target_file"])
