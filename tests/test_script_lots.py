"""Scripts of one lot don't mix, whatever the number of lots."""

import pytest

from tessera.plans import QUERIES
from tessera.sources import script_coverage

from test_queries import rows


@pytest.mark.parametrize("lots", [1, 7])
def test_counts_do_not_depend_on_lots(spark, sf_dir, monkeypatch, lots):
    expected = rows(QUERIES["mapped_coverage"](spark, sf_dir).toPandas())
    monkeypatch.setattr(script_coverage, "LOTS", lots)
    assert rows(QUERIES["mapped_coverage"](spark, sf_dir).toPandas()) == expected and len(expected) > 1000
