"""Blocks of vectors in a row each: products at the threshold, odd vectors, one row a block and pair."""

import numpy as np
import pytest

from tessera.operators import metrics


@pytest.mark.parametrize("size", [3, 4096])
def test_products_at_the_threshold(spark, size):
    """0.1 * 3 summed in order is more than 0.3, and is a pair; nulls are none."""
    rows = [(1, [0.1, 0.1, 0.1]), (2, [1.0, 1.0, 1.0]), (3, [0.3, 0.0, 0.0]), (4, [0.29999999, 0.0, 0.0]), (5, None), (None, [9.0, 9.0, 9.0]), (6, [1e8, -1e8, 0.5])]
    got = metrics.similar_pairs(spark.createDataFrame(rows, "id int, x array<double>"), "id", "x", 0.3, size).collect()
    full = [(i, x) for i, x in rows if i and x]
    expected = [(i, j) for i, x in full for j, y in full if i < j and np.cumsum(np.array(x) * np.array(y))[-1] >= 0.3]
    assert sorted(map(tuple, got)) == expected and (1, 2) in expected and (2, 3) in expected


def test_a_block_goes_to_its_pairs_as_one_row(spark):
    """Before, each vector was a row of each pair of blocks."""
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "id long, x array<double>")
    plan = metrics.similar_pairs(v, "id", "x", 0.3, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.index("Generate") < plan.index("collect_list")


def test_lengths_that_differ_are_an_error(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0])], "id long, x array<double>")
    with pytest.raises(Exception, match="different lengths"):
        metrics.similar_pairs(v, "id", "x", 0.3).collect()
