"""Sites of unresolved specifiers: counted first, equal to the rows of unresolved()."""

import random
from collections import Counter

from tessera.operators import resolution as R
from tessera.plans import QUERIES


def test_counts_are_those_of_the_rows(spark):
    rng = random.Random(4)
    specifiers = ["./a", "./a.js", "../b", "/b", "#c", "kit", "../m0/x", "./gone?raw", "@k/a", "", None]
    rows = [(rng.choice(["s/f.ts", "s/g.ts", "f.ts", None]), rng.choice(specifiers)) for _ in range(150)]
    imports = spark.createDataFrame(rows, "file string, source string")
    files = spark.createDataFrame([("s/a.ts",), ("b/index.js",), ("b/index.js",), ("lib/a.tsx",)], "path string")
    for aliases in (None, spark.createDataFrame([("@k", "lib"), ("#c", "b")], "prefix string, target string")):
        every = R.unresolved(R.resolve(imports, files, aliases), ["../m0"]).collect()
        got = R.unresolved_sites(imports, files, ["../m0"], aliases).collect()
        assert Counter(r["source"] for r in every) == {r["source"]: r["sites"] for r in got} and len(got) > 3


def test_imports_are_read_once(spark, sf_dir):
    """Before, they were read for what they ask and again for their rows."""
    plan = QUERIES["unresolved_imports"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    assert sum("FileScan" in line and "l_partkey" in line for line in plan.split("\n")) == 1
