"""Queries of text scans: clones, mutants, styles and security candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clones, detectors, mutation, security, styling
from ..sources.tables import LINES_SQL, lines
from .registry import query

WORDS_SQL = "w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)"


def words(t):
    return clones.dealt(t("documents").select("doc_id", "text")).select("doc_id", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), "").alias("w"))


@query(f"""WITH {WORDS_SQL}, k AS (SELECT doc_id, unnest(range(len(w) - 29)) AS pos, w FROM w WHERE len(w) >= 30), a AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 30], ' ') AS h FROM k),
  m AS (SELECT h, min((doc_id, pos)) AS home FROM a GROUP BY 1 HAVING count(*) > 1),
  x AS (SELECT doc_id, pos, home[1] AS of_doc, pos - home[2] AS shift FROM a JOIN m USING (h) WHERE (doc_id, pos) <> home),
  r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, of_doc, shift ORDER BY pos) AS g FROM x)
  SELECT doc_id, min(pos) AS first, max(pos) + 29 AS last, of_doc, min(pos) - shift AS of_first FROM r GROUP BY doc_id, of_doc, shift, g""")
def clone_runs(t, spark, d):
    return clones.first_copies(words(t), 30)


@query(f"""WITH {WORDS_SQL}, k AS (SELECT doc_id, unnest(range(len(w) - 29)) AS pos, w FROM w WHERE len(w) >= 30), h AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 30], ' ') AS h FROM k),
  a AS (SELECT * FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id, h ORDER BY pos) AS before FROM h) WHERE before IS NULL OR pos - before >= 30), c AS (SELECT h, row_number() OVER () AS c FROM (SELECT h FROM a GROUP BY 1 HAVING count(*) > 1)), s AS (SELECT doc_id, pos, c FROM a JOIN c USING (h)),
  m AS (SELECT a.doc_id, a.pos, a.pos - b.pos AS shift, b.doc_id AS other FROM s a JOIN s b USING (c) WHERE (a.doc_id, a.pos) < (b.doc_id, b.pos)),
  r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY pos) AS g FROM m), e AS (SELECT doc_id, min(pos) AS first, max(pos) + 29 AS last FROM r GROUP BY doc_id, other, shift, g),
  t AS (SELECT DISTINCT array_to_string(w[first + 1:last + 1], ' ') AS t, last - first + 1 AS n, w[first + 1:first + 30] AS f FROM e JOIN w USING (doc_id)),
  i AS (SELECT t, n, s.doc_id, s.pos AS first FROM t JOIN c ON c.h = array_to_string(f, ' ') JOIN s USING (c) JOIN w USING (doc_id) WHERE array_to_string(w[s.pos + 1:s.pos + n], ' ') = t),
  o AS (SELECT t, min((doc_id, first)) AS home, count(*) AS instances FROM i GROUP BY 1)
  SELECT doc_id, first, first + n - 1 AS last, home[1] AS of_doc, home[2] AS of_first, instances FROM i JOIN o USING (t)""")
def maximal_clones(t, spark, d):
    return clones.maximal_groups(words(t), 30, whole=True)


@query("WITH " + LINES_SQL + """, p AS (SELECT doc_id, list_filter(string_split_regex(lower(line), '[^a-z]+'), lambda x: x <> '') AS w FROM lines)
  SELECT array_to_string(list_transform(w, lambda x: list_position(w, x)), ',') AS pattern, count(*) AS instances, count(DISTINCT doc_id) AS files FROM p WHERE len(w) >= 6 GROUP BY 1 HAVING count(*) > 1""")
def renamed_clones(t, spark, d):
    w = F.array_remove(F.split(F.lower("line"), "[^a-z]+"), "")
    p = lines(spark, d).select("doc_id", w.alias("w")).filter("size(w) >= 6")
    key = F.array_join(F.transform(clones.name_pattern(F.col("w")), lambda x: x.cast("string")), ",")
    return p.groupBy(key.alias("pattern")).agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("doc_id").alias("files")).filter("instances > 1")


@query("WITH " + LINES_SQL + """, v AS (SELECT doc_id, pos, list_filter(string_split_regex(lower(line), '[^a-z]+'), lambda x: x <> '') AS w FROM lines),
  p AS (SELECT a.doc_id || ':' || a.pos AS pair, unnest(range(least(len(a.w), len(b.w)))) AS pos, a.w AS a, b.w AS b FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
  n AS (SELECT pair, pos, nullif(a[pos + 1], 'the') AS l, nullif(b[pos + 1], 'the') AS r FROM p), m AS (SELECT pair, list(l ORDER BY pos) AS l, list(r ORDER BY pos) AS r FROM n GROUP BY 1),
  c AS (SELECT n.pair, n.pos, coalesce(list_max(list_filter(range(n.pos), lambda i: n.l IS NOT NULL AND n.r IS NOT NULL AND m.l[i + 1] IS NOT NULL AND m.r[i + 1] IS NOT NULL AND (m.l[i + 1] = n.l) <> (m.r[i + 1] = n.r))) + 1, 0) AS c FROM n JOIN m USING (pair)),
  s AS (SELECT pair, pos, max(c) OVER (PARTITION BY pair ORDER BY pos) AS first FROM c) SELECT pair, first, max(pos) + 1 - first AS length FROM s GROUP BY 1, 2 HAVING max(pos) + 1 - first >= 12""")
def renamed_windows(t, spark, d):
    names = F.transform(F.split("text", "\n", -1), lambda line: F.array_remove(F.split(F.lower(line), "[^a-z]+"), ""))
    each = t("documents").filter("doc_id IS NOT NULL").select("doc_id", F.transform(names, lambda w: F.transform(w, lambda x: F.when(x != "the", x))).alias("w"))
    # a line and the next one stand in one row of a document, so nothing is joined; an empty line has no names
    beside = F.arrays_zip(F.col("w").alias("left"), F.slice("w", 2, F.size("w")).alias("right"))
    both = clones.dealt(each).select("doc_id", F.posexplode(beside).alias("at", "x"))
    pair = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("at").cast("string"))
    return clones.one_to_one_stretches(both.select(pair.alias("pair"), "x.left", "x.right"), 12)


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 100 AS first, l_partkey % 100 + l_quantity::BIGINT AS last FROM lineitem)
  SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.doc_id = b.doc_id AND b.first <= a.first AND b.last >= a.last AND (b.first, b.last) <> (a.first, a.last))""")
def maximal_spans(t, spark, d):
    return clones.without_contained(spans(t))


def line_spans(t):
    first = F.col("l_partkey") % 100
    return t("lineitem").select(F.col("l_orderkey").alias("doc_id"), first.alias("first"), (first + F.col("l_quantity").cast("long")).alias("last"))


def spans(t):
    return line_spans(t).distinct()


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 100 AS first, l_partkey % 100 + l_quantity::BIGINT AS last FROM lineitem)
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = doc_id AND o_custkey % 90 <= last AND first <= o_custkey % 90 + 5)""")
def unmasked_spans(t, spark, d):
    ignored = t("orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 90).alias("start"), (F.col("o_custkey") % 90 + 5).alias("stop"))
    return clones.without_ignored(spans(t), ignored).select("doc_id", "first", "last")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 100 AS first, l_partkey % 100 + l_quantity::BIGINT AS last FROM lineitem)
  SELECT doc_id, first, last, CASE WHEN o_orderstatus = 'F' THEN 'file' ELSE o_orderpriority END AS reason FROM s JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus = 'F' OR o_custkey % 100 BETWEEN first AND last""")
def dead_clones(t, spark, d):
    o = t("orders")
    return clones.dead_clones(line_spans(t), o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id")), o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 100).alias("line"), F.col("o_orderpriority").alias("name"))).distinct()


@query("""WITH t AS (SELECT doc_id, unnest(range(len(x))) AS pos, x FROM (SELECT doc_id, regexp_extract_all(text, '"[^"\\n]*"|''[^''\\n]*''|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_ \\t\\r\\n]') AS x FROM documents)),
  r AS (SELECT * FROM (VALUES %s) v(operator, token, replacement))
  SELECT doc_id AS file, pos, operator, token, replacement, sha256(concat_ws('|', doc_id, pos, operator, replacement)) AS mutant_id FROM t JOIN r ON x[pos + 1] = token""" % ", ".join(str(tuple(r)) for r in mutation.REPLACEMENTS))
def mutant_sites(t, spark, d):
    toks = t("documents").select(F.col("doc_id").alias("file"), F.posexplode(clones.tokens(F.col("text"), "strict")).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    return mutation.mutants(toks, mutation.replacement_table(spark, mutation.REPLACEMENTS))


@query("""SELECT DISTINCT c_custkey AS file, c_name AS name, c_nationkey * 20 AS first, c_nationkey * 20 + 300 AS last FROM customer JOIN events ON user_id = c_custkey AND event_id % 1000 BETWEEN c_nationkey * 20 AND c_nationkey * 20 + 300""")
def widened_functions(t, spark, d):
    f = t("customer").select(F.col("c_custkey").alias("file"), F.col("c_name").alias("name"), (F.col("c_nationkey") * 20).alias("first"), (F.col("c_nationkey") * 20 + 300).alias("last"))
    return mutation.widen(t("events").select(F.col("user_id").alias("file"), (F.col("event_id") % 1000).alias("line")), f)


@query("""WITH u AS (SELECT page_id, unnest(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(html, 'class="([^"]*)"', 1), lambda x: string_split(x, ' '))), lambda y: y <> ''))) AS name FROM pages)
  SELECT name, count(*) AS pages FROM u GROUP BY 1""")
def class_usage(t, spark, d):
    return t("pages").select("page_id", F.explode_outer(styling.class_tokens(F.col("html"))).alias("name")).filter("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("pages"))


@query("""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'class="([^" ]+)"', 1)) AS name FROM pages), d AS (SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT 'ad')
  SELECT name, 'unresolved' AS side FROM u WHERE name NOT IN (SELECT name FROM d) UNION SELECT name, 'unreferenced' FROM d WHERE name NOT IN (SELECT name FROM u)""")
def class_findings(t, spark, d):
    used = t("pages").select(F.explode_outer(styling.class_tokens(F.col("html"))).alias("name"), styling.has_dynamic_classes(F.col("html")).alias("dynamic"))
    sheet = t("nation").select(F.concat(F.lit("."), F.lower("n_name"), F.lit("{margin:0.5em} .ad{}")).alias("css"))
    return styling.class_findings(used, sheet.select(F.explode(styling.defined_classes(F.col("css"))).alias("name")))


@query("""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)) AS block FROM pages)
  SELECT block, count(DISTINCT page_id) AS owners, count(*) AS instances FROM b GROUP BY 1 HAVING count(*) >= 2""")
def repeated_style_blocks(t, spark, d):
    b = t("pages").select("page_id", F.explode_outer(styling.style_blocks(F.col("html"))).alias("block")).filter("block IS NOT NULL")
    return styling.repeated_blocks(b, "page_id", "block")


@query("""WITH c AS (SELECT event_id AS line, user_id AS file, event_type AS callee, value > 100 AS literal FROM events),
  k AS (SELECT * FROM (VALUES ('click', 'xss', 1, true), ('error', 'log', NULL, false), ('signup', 'sql', 2, false)) v(callee, rule, module, dynamic_only))
  SELECT file, line, c.callee, rule FROM c JOIN k USING (callee) WHERE NOT (dynamic_only AND literal) AND (module IS NULL OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = file AND c_nationkey % 3 = module))""")
def security_sinks(t, spark, d):
    calls = t("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.col("event_type").alias("callee"), (F.col("value") > 100).alias("literal"))
    catalogue = spark.createDataFrame([("click", "xss", 1, True), ("error", "log", None, False), ("signup", "sql", 2, False)], "callee string, rule string, module int, dynamic_only boolean")
    return security.sinks(calls, catalogue, t("customer").select(F.col("c_custkey").alias("file"), (F.col("c_nationkey") % 3).alias("module")))


@query("""WITH p AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderkey % 4 = 0 AS hidden, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS place FROM orders)
  SELECT o_orderkey, CASE WHEN hidden THEN '' ELSE sha256(concat_ws('|', o_custkey, o_orderpriority, place)) END AS finding_id FROM p""")
def suppressed_ids(t, spark, d):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderkey") % 4 == 0).alias("hidden"))
    return security.stable_ids(o, ["o_custkey", "o_orderpriority"], ["o_orderkey"], "hidden").select("o_orderkey", F.coalesce("finding_id", F.lit("")).alias("finding_id"))


@query("""SELECT l_orderkey, arg_min(l_suppkey, l_partkey * 1000 + l_suppkey) FILTER (l_returnflag = 'R') AS client, arg_min(l_suppkey, l_partkey * 1000 + l_suppkey) FILTER (l_returnflag = 'N') AS server
  FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'N')""")
def mixed_origins(t, spark, d):
    pos = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return detectors.first_of_both(t("lineitem"), "l_orderkey", "l_suppkey", pos, F.col("l_returnflag") == "R", F.col("l_returnflag") == "N", "client", "server")


@query("""SELECT o_custkey, o_orderpriority AS slot, count(DISTINCT o_orderstatus) AS spellings, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS names
  FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1""")
def segment_conflicts(t, spark, d):
    return detectors.spelling_conflicts(t("orders").withColumnRenamed("o_orderpriority", "slot"), ["o_custkey", "slot"], "o_orderstatus")


@query("""SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations d WHERE c.conv_id = d.conv_id AND d.role <> 'user' AND d.turn < c.turn)""")
def misplaced_directives(t, spark, d):
    return detectors.misplaced(t("conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn")


@query("""SELECT l_partkey, CASE WHEN bool_and(l_returnflag = 'R') THEN 'moved' ELSE 'kept' END AS part, count(*) AS n FROM lineitem GROUP BY 1""")
def split_findings(t, spark, d):
    moved, kept = detectors.split(t("lineitem").groupBy("l_partkey").agg(F.bool_and(F.col("l_returnflag") == "R").alias("m"), F.count(F.lit(1)).alias("n")), F.col("m"))
    return moved.select("l_partkey", F.lit("moved").alias("part"), "n").unionByName(kept.select("l_partkey", F.lit("kept").alias("part"), "n"))


VARIABLE = "concat(CASE p_partkey % 7 WHEN 0 THEN 'VITE_' WHEN 1 THEN 'PUBLIC' WHEN 2 THEN 'GIT_' WHEN 3 THEN 'NODE_' ELSE 'APP.' END, {parts}, CASE p_size % 4 WHEN 0 THEN '_SHA' WHEN 1 THEN '' WHEN 2 THEN '-MODE' ELSE '_ID' END)"
SOURCE = "concat(CASE p_partkey % 3 WHEN 0 THEN 'process.env.' WHEN 1 THEN 'import.meta.env.' ELSE 'req.query.' END, {variable})"
_LISTED = "['AUTH', 'KEY', 'ENV', 'NAME', 'REF', 'TOKENS', 'TOKEN', 'TAG']"


@query("""WITH v AS (SELECT p_partkey, %s AS path, %s AS name FROM part), x AS (SELECT *, string_split_regex(name, '[^A-Za-z0-9]+') AS w FROM v),
  p AS (SELECT *, name = 'NODE_ENV' OR starts_with(name, 'VITE_') OR starts_with(name, 'PUBLIC_') OR (list_has_any(w, %s) AND NOT list_has_any(w, %s)) AS public FROM x)
  SELECT p_partkey AS id, path, public, NOT public AND NOT starts_with(path, 'req.') AS secret FROM p""" % (
    SOURCE.format(variable=VARIABLE.format(parts=_LISTED + "[p_partkey % 8 + 1]")), VARIABLE.format(parts=_LISTED + "[p_partkey % 8 + 1]"), security.METADATA_PARTS, security.SECRET_PARTS))
def secret_sources(t, spark, d):
    name = VARIABLE.format(parts="element_at(array" + _LISTED.replace("[", "(").replace("]", ")") + ", cast(p_partkey % 8 + 1 AS int))")
    p = t("part").select(F.col("p_partkey").alias("id"), F.expr(SOURCE.format(variable=name)).alias("path"), F.expr(name).alias("name"))
    return p.select("id", "path", security.public_variable(F.col("name")).alias("public"), security.secret_source(F.col("path")).alias("secret"))
