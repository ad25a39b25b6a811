"""Where the queries of this folder and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query of (read table, session, folder) under its name with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: read(spark, sf_dir, name), spark, sf_dir)

        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return f

    return add
