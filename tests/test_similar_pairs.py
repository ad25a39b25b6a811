"""Similar vectors over all pairs, in one and in many blocks."""

import numpy as np
import pytest

from tessera.operators import metrics
from tessera.plans import QUERIES
from tessera.sources.tables import read


@pytest.mark.parametrize("size", [7, 2048])
def test_all_pairs(spark, size):
    x = np.random.default_rng(5).normal(size=(40, 4))
    v = spark.createDataFrame([(i * 3 + 1, i % 2, r.tolist()) for i, r in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = metrics.similar_pairs(v, "vec_id", "embedding", 0.3, size).collect()
    expected = [(i * 3 + 1, j * 3 + 1) for i in range(40) for j in range(i + 1, 40) if x[i] @ x[j] >= 0.3]
    assert sorted(map(tuple, got)) == expected


def test_query_returns_pairs_of_all_labels(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").toPandas()
    x = np.array(e["embedding"].tolist(), np.float64)
    assert QUERIES["similar_code_pairs"](spark, sf_dir).count() == int(np.triu(x @ x.T >= 0.3, 1).sum())
