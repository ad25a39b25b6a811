"""Functions that hold a changed line, against all pairs; no function is repeated for its lines."""

import random

from tessera.operators import mutation


def test_widened_functions_are_those_with_a_line(spark):
    rng = random.Random(2)
    maybe = lambda x: x if rng.random() > 0.05 else None
    functions = [(maybe(rng.randint(0, 9)), f"f{i % 150}", maybe(a := rng.randint(0, 400)), maybe(a + rng.randint(-5, 60))) for i in range(200)]
    functions += functions[:20]
    lines = [(maybe(rng.randint(0, 9)), maybe(rng.randint(0, 460))) for _ in range(40)]
    expected = {f for f in functions if None not in (f[0], f[2], f[3]) and any(x == f[0] and y is not None and f[2] <= y <= f[3] for x, y in lines)}
    found = mutation.widen(spark.createDataFrame(lines, "file long, line long"), spark.createDataFrame(functions, "file long, name string, first long, last long"))
    rows = found.collect()
    assert found.columns == ["file", "name", "first", "last"] and len(rows) == len(expected) > 20 and {tuple(r) for r in rows} == expected
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
