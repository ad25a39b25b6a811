"""Calls with their arguments in a row: dealt out once, by function."""

import random
from collections import defaultdict

import pytest

from tessera.operators import detectors
from tessera.plans import QUERIES


def test_each_table_is_dealt_out_few_times(spark, sf_dir):
    """Before, calls and each kind of argument met by call in a join of their own: over ten exchanges."""
    plan = QUERIES["constant_arguments"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "Broadcast" not in line for line in plan.split("\n")) <= 4


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_calls_with_odd_arguments(spark, seed):
    rng = random.Random(seed)
    params = [(f, i, k, rng.choice([True, False, None])) for f in (1, 2, 3, None) for i, k in ((0, None), (1, None), (1, "x"), (1, "y"))] * 2
    calls = [(f, c) for c in range(9) for f in rng.sample([1, 2, 3, 4, None], 2)] + [(1, None), (2, 1)]
    args = [(rng.choice([*range(9), None]), rng.choice([0, 1, None]), rng.choice([None, None, "x", "y"]), rng.choice(["literal", "literal", "object", "same", "undefined", "unknown", None]), rng.choice(["a", None])) for _ in range(20)]
    given = defaultdict(list)
    for c, i, k, kind, value in args:
        if None not in (c, i):
            given[c, i, k].append((kind is not None, kind or "", value is not None, value or ""))
    expected = []
    for f, i, k in {p[:3] for p in params if p[0]}:
        may, seen, lost = any(p[3] for p in params if p[:3] == (f, i, k)), [], False
        for c in {c for g, c in calls if g == f}:
            whole, arg = (max(given[c, i, x]) if given.get((c, i, x)) else None for x in (None, k))
            kind = whole[1] if whole and whole[0] else None
            got = whole if k is None else arg if kind == "object" else None
            if got and (got[1] == "same" or not got[0]):
                continue
            if k and (whole is None or kind == "undefined"):
                lost |= not may
            elif k and whole and kind not in ("object", None):
                lost = True
            else:
                lost |= bool(got) and got[1] in ("unknown", "object")
            seen.append(got)
        real = [x for x in seen if x]
        if lost or len(seen) < 2:
            continue
        if not real and (may or k):
            expected.append((f, i, k, "never-passed", None, len(seen)))
        elif len(real) == len(seen) and len(set(real)) == 1:
            expected.append((f, i, k, "identical-argument", real[0][3] or None, len(seen)))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = detectors.constant_parameters(frame(params, "fn int, index int, key string, optional boolean"), frame(calls, "fn int, call int"), frame(args, "call int, index int, key string, kind string, value string"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))
