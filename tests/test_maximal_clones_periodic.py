"""The query of maximal clones against its SQL on texts that repeat themselves with short periods."""

import random

import duckdb
import pandas as pd

from tessera import plans


def test_instances_behind_periodic_text(spark, tmp_path):
    rng = random.Random(1)

    def piece():
        period = [rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 29, 31, 40]))]
        n = rng.randint(10, 120)
        return (period * (n // len(period) + 1))[:n] if rng.random() < 0.5 else [rng.choice("abcdefghijklmnop") for _ in range(n)]

    pieces, texts = [piece() for _ in range(40)], []
    for _ in range(150):
        w = []
        for x in rng.choices(pieces, k=rng.randint(0, 6)):
            w += x[rng.randint(0, len(x) // 2) : rng.randint(len(x) // 2, len(x))] if rng.random() < 0.5 else x
        texts.append(" ".join(w) if rng.random() > 0.03 else None)
    pd.DataFrame({"doc_id": range(150), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    columns = ["doc_id", "first", "last", "of_doc", "of_first", "instances"]
    expected = con.sql(plans.SQL["maximal_clones"]).df()[columns]
    got = plans.QUERIES["maximal_clones"](spark, str(tmp_path)).toPandas()[columns]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, expected.values.tolist())) and len(expected) > 500
