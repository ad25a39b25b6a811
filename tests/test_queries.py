"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from tessera import plans


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted([tuple(round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    expected = con.sql(plans.SQL[name]).df()
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b", "shared", "degree"]
