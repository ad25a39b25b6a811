"""Levels of origins: each level's keys are written before they are looked up, few or many."""

import pytest

from tessera.operators import provenance


@pytest.mark.parametrize("few", [0, 50_000])
def test_keys_of_a_level_are_not_told_again(spark, monkeypatch, few):
    """Before, each use of a level's keys joined them with all edges again."""
    monkeypatch.setattr(provenance, "FEW_KEYS", few, raising=False)
    plans, steps = [], provenance._steps

    def watched(keys, bindings):
        plans.append(keys._jdf.queryExecution().optimizedPlan().toString())
        return steps(keys, bindings)

    monkeypatch.setattr(provenance, "_steps", watched)
    rows = [("u", "local", "x", "x", "./a", "a"), ("a", "export", "x", "y", "./b", "b"), ("b", "export", "y", "z", "kit", None)]
    b = spark.createDataFrame(rows, "file string, scope string, name string, imported string, source string, target string")
    got = provenance.value_origins(spark.createDataFrame([("u", "x"), ("u", "x")], "file string, symbol string"), b)
    assert list(map(tuple, got.collect())) == [("u", "x", "kit#z")]
    assert len(plans) == 3 and not any("Join" in p or "Aggregate" in p for p in plans)
