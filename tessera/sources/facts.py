"""Facts of source code, read from the driver's tables, each with the same in SQL.

Events stand for relations between owners and names (imports, members, props, by event type), documents for exports,
labels and turns of conversations for references to them, orders for declared dependencies and their lines for uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS_SQL = "pairs AS (SELECT DISTINCT event_type AS kind, user_id AS owner, json_extract_string(props, '$.k')::BIGINT AS name FROM events)"


def pairs(t, *kinds: str) -> DataFrame:
    """(kind, owner, name), distinct, of the events of some types, or of all."""
    e = t("events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("owner"), F.get_json_object("props", "$.k").cast("long").alias("name"))
    return (e.filter(F.col("kind").isin(*kinds)) if kinds else e).distinct()


EXPORTS_SQL = "exports AS (SELECT doc_id AS export, source AS file, lang || n_chars % 7 AS name, lang = 'fr' AS is_type, n_chars > 3000 AS deprecated, n_chars < 100 AS suppressed, n_chars AS line FROM documents)"


def exports(t) -> DataFrame:
    return t("documents").selectExpr("doc_id AS export", "source AS file", "concat(lang, n_chars % 7) AS name", "lang = 'fr' AS is_type", "n_chars > 3000 AS deprecated", "n_chars < 100 AS suppressed", "n_chars AS line")


REFS_SQL = """refs AS (SELECT doc_id AS export, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'label' END AS from_file, quality = 1 AS is_value, doc_id AS line FROM labels
  UNION ALL SELECT conv_id, role, turn % 2 = 0, turn FROM conversations)"""


def refs(t) -> DataFrame:
    one = t("labels").selectExpr("doc_id AS export", "CASE WHEN toxic = 1 THEN 'toxic' ELSE 'label' END AS from_file", "quality = 1 AS is_value", "doc_id AS line")
    return one.unionByName(t("conversations").selectExpr("conv_id AS export", "role AS from_file", "turn % 2 = 0 AS is_value", "turn AS line"))


DEPS_SQL = """deps AS (SELECT o_custkey AS workspace, o_orderkey AS name, CASE WHEN o_orderpriority < '2' THEN 'dev' WHEN o_orderpriority < '3' THEN 'optional' WHEN o_orderpriority < '4' THEN 'peer' ELSE 'prod' END AS kind FROM orders),
  uses AS (SELECT l_orderkey AS name, l_suppkey AS file, l_linestatus = 'O' AS type_only, l_returnflag = 'R' AS is_test FROM lineitem)"""


def deps(t) -> DataFrame:
    kind = "CASE WHEN o_orderpriority < '2' THEN 'dev' WHEN o_orderpriority < '3' THEN 'optional' WHEN o_orderpriority < '4' THEN 'peer' ELSE 'prod' END AS kind"
    return t("orders").selectExpr("o_custkey AS workspace", "o_orderkey AS name", kind)


def uses(t) -> DataFrame:
    return t("lineitem").selectExpr("l_orderkey AS name", "l_suppkey AS file", "l_linestatus = 'O' AS type_only", "l_returnflag = 'R' AS is_test")
