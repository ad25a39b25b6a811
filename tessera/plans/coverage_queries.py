"""Coverage through source maps on scripts made of the lines of each part, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import script_coverage
from .registry import query


def dumps(t):
    """(part, dump, value, n): a dump a part, whose script has a line of 20 units for each of its lineitems in order, the
    i-th mapped to line i of the source, and a range from each returned one over as many lines as its number."""
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")))
    p = t("lineitem").groupBy(F.col("l_partkey").alias("part")).agg(rows.alias("x")).withColumn("n", F.size("x"))
    url = "concat('file:///p/dist/part', part, '.js')"
    # the digit of a number below 16 is the even one at twice its place
    signs = "array_join(transform(x, (r, i) -> concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef', 2 * r.l_linenumber + 1, 1), 'A', if(i = 0, 'A', 'C'), 'A')), ';')"
    range_of = "named_struct('startOffset', i * 21, 'endOffset', least((i + r.l_linenumber) * 21, n * 21) - 1, 'count', r.l_suppkey % 3)"
    inner = f"transform(filter(transform(x, (r, i) -> if(r.l_returnflag = 'R', {range_of}, null)), r -> r IS NOT NULL), r -> named_struct('ranges', array(r)))"
    whole = "array(named_struct('ranges', array(named_struct('startOffset', 0, 'endOffset', n * 21 - 1, 'count', bigint(1)))))"
    source = "if(part % 2 = 0, concat('../src/part', part, '.ts'), concat('webpack://app/./src/part', part, '.ts'))"
    entry = f"named_struct('lineLengths', array_repeat(20, n), 'data', named_struct('sources', array({source}), 'mappings', {signs}))"
    value = f"to_json(named_struct('result', array(named_struct('url', {url}, 'functions', concat({whole}, {inner}))), 'source-map-cache', map({url}, {entry})))"
    return p.selectExpr("part", "concat('d', part) AS dump", f"{value} AS value", "n")


@query("""WITH x AS (SELECT l_partkey AS part, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_returnflag) - 1 AS i, l_linenumber AS k, l_suppkey % 3 AS count, l_returnflag = 'R' AS r FROM lineitem),
  n AS (SELECT part, count(*) AS n FROM x GROUP BY part), g AS (SELECT part, i AS place, i * 21 AS a, least((i + k) * 21, n * 21) - 1 AS b, count FROM x JOIN n USING (part) WHERE r UNION ALL SELECT part, -1, 0, n * 21 - 1, 1 FROM n)
  SELECT '/p/src/part' || x.part || '.ts' AS path, x.i::VARCHAR AS id, coalesce(arg_min(g.count, (b - a, place)), 0) AS count FROM x LEFT JOIN g ON g.part = x.part AND a <= x.i * 21 + x.k AND x.i * 21 + x.k < b GROUP BY x.part, x.i""")
def mapped_coverage(t, spark, d):
    made = dumps(t)
    path = "concat('/p/src/part', part, '.ts')"
    files = t("part").selectExpr("concat('/p/src/part', p_partkey, '.ts') AS path", "string(null) AS content")
    each = t("lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # two statements more than there are lines: no script maps them
    spots = each.selectExpr(f"{path} AS path", "'statement' AS kind", "explode(sequence(0, int(n) + 1)) AS id")
    spots = spots.selectExpr("*", "id + 1 AS line", "3 * (id % 2) AS column", "int(null) AS end_line", "int(null) AS end_column", "bigint(null) AS offset")
    return script_coverage.script_counts(made.select("dump", "value"), files, spots).select("path", "id", "count")
