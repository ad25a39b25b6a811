"""Health, churn, coverage and scoring operators, and set algebra over findings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lots import lots
from ..functions.text import matches_globs


def crap(complexity: Column, covered: Column) -> Column:
    """Change-risk score of a complexity and a share of coverage."""
    return complexity * complexity * F.pow(1 - covered, 3) + complexity


def crap_or_estimate(functions: DataFrame, measured: DataFrame, reach: DataFrame) -> DataFrame:
    """(path, name, crap, model): scores of functions(path, name, exported, complexity) by their measured(path, name,
    covered, statements), else by an estimate from reach(path, name): what tests import, name null where they reach the file.

    Estimates are fixed values: 0.85 for an export that a test imports, 0.4 for other code of a reached file, 0 for the
    rest. A function that is measured twice adds up; one without statements falls back to the estimate.
    """
    m = measured.groupBy("path", "name").agg((F.sum("covered") / F.nullif(F.sum("statements"), F.lit(0))).alias("share"))
    files = reach.select("path").distinct().withColumn("__file", F.lit(True))
    names = reach.filter("name IS NOT NULL").select("path", "name").distinct().withColumn("__name", F.lit(True))
    f = functions.join(m, ["path", "name"], "left").join(files, "path", "left").join(names, ["path", "name"], "left")
    guess = F.when(F.col("exported") & F.col("__name"), 0.85).when(F.col("__file"), 0.4).otherwise(0.0)
    score = crap(F.col("complexity"), F.coalesce("share", guess))
    return f.select("path", "name", score.alias("crap"), F.when(F.col("share").isNotNull(), "measured").otherwise("estimated").alias("model"))


def trend(df: DataFrame, key: str, ts: str, middle: str) -> DataFrame:
    """Events in the older and recent half and their trend; without older events any recent one is accelerating."""
    recent = F.col(ts) >= F.lit(middle).cast("timestamp")
    out = df.groupBy(key).agg(F.sum(F.when(recent, 0).otherwise(1)).alias("older"), F.sum(F.when(recent, 1).otherwise(0)).alias("recent"))
    ratio = F.col("recent") / F.nullif("older", F.lit(0))
    label = F.when((F.col("older") == 0) | (ratio > 1.5), "accelerating").when(ratio < 0.67, "cooling").otherwise("stable")
    return out.withColumn("trend", label)


def recency_weight(df: DataFrame, key: str, ts: str, as_of: str, half_life_days: int = 90) -> DataFrame:
    """Sum of weights that halve every `half_life_days` before as_of, in whole days."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(ts).cast("date"))
    return df.groupBy(key).agg(F.round(F.sum(F.pow(F.lit(0.5), age / half_life_days)), 6).alias("weight"))


def change_coupling(changes: DataFrame, static: DataFrame | Column, least_shared: int = 3, least_changes: int = 5, most_files: int = 50) -> DataFrame:
    """Pairs of files that change together without a static edge: shared commits and degree, from changes(commit, path).

    static is a table of edges(a, b) or a condition on a and b.
    Commits of more than `most_files` files are left out, so a commit gives a bounded number of pairs.
    """
    c = changes.select("commit", "path").distinct()
    c = c.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("commit"))).filter(F.col("n") <= most_files).drop("n")
    revisions = c.groupBy("path").agg(F.count(F.lit(1)).alias("revisions")).filter(F.col("revisions") >= least_changes)
    x, y = c.toDF("commit", "a"), c.toDF("commit", "b")
    pairs = x.join(y, "commit").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least_shared)
    pairs = pairs.join(revisions.toDF("a", "ra"), "a").join(revisions.toDF("b", "rb"), "b")
    pairs = pairs.filter(~static) if isinstance(static, Column) else pairs.join(static, ["a", "b"], "left_anti")
    return pairs.select("a", "b", "shared", F.round(2 * F.col("shared") / (F.col("ra") + F.col("rb")), 2).alias("degree"))


def ownership(changes: DataFrame, path: str, author: str) -> DataFrame:
    """Top author of each path, share of changes, number of authors, and the authors that make up half of the changes."""
    n = lots(changes.select(path, author), path).groupBy(path, author).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(path)
    most = w.orderBy(F.desc("n"), author)  # one order for both, so that rows are sorted once
    so_far = F.sum("n").over(most.rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumns({"rank": F.row_number().over(most), "before": so_far - F.col("n")})
    n = n.withColumns({"total": F.sum("n").over(w), "authors": F.count(F.lit(1)).over(w)})
    out = n.groupBy(path).agg(
        F.max(F.when(F.col("rank") == 1, F.col(author))).alias("top"), F.max(F.when(F.col("rank") == 1, F.round(F.col("n") / F.col("total"), 4))).alias("share"),
        F.max("authors").alias("authors"), F.sum(F.when(2 * F.col("before") < F.col("total"), 1).otherwise(0)).alias("bus_factor"),
    )
    return out


def hotspots(df: DataFrame, key: str, churn: str, complexity: str) -> DataFrame:
    """Score 0 to 100: product of churn and complexity, each scaled by its maximum."""
    top = df.agg(F.max(churn).alias("mc"), F.max(complexity).alias("mx"))
    score = F.round(100 * F.col(churn) / F.col("mc") * F.col(complexity) / F.col("mx"), 2)
    return df.crossJoin(F.broadcast(top)).select(key, score.alias("score"))  # one row


def coverage_summary(files: DataFrame, covered: Column) -> DataFrame:
    """Files, covered ones, and their percent to one decimal; 100 without files."""
    out = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.when(covered, 1).otherwise(0)), F.lit(0)).alias("covered"))
    return out.withColumn("percent", F.when(F.col("files") == 0, 100.0).otherwise(F.round(100 * F.col("covered") / F.col("files"), 1)))


def compare_snapshots(base: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """introduced, worsened, improved, inherited or fixed for each key of base and head."""
    b, h = base.select(key, F.col(value).alias("b")), head.select(key, F.col(value).alias("h"))
    state = (
        F.when(F.col("b").isNull(), "introduced").when(F.col("h").isNull(), "fixed").when(F.col("h") > F.col("b"), "worsened")
        .when(F.col("h") < F.col("b"), "improved").otherwise("inherited")
    )
    return b.join(h, key, "full_outer").select(key, state.alias("state"))


def sample_per_group(df: DataFrame, keys: list[str], rank: Column, ident: str, k: int) -> DataFrame:
    """k rows a group by rank, then by the first 8 bytes of the id's SHA-256, then by id."""
    w = Window.partitionBy(*keys).orderBy(rank, F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, 16), ident)
    return df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def within_ranges(points: DataFrame, ranges: DataFrame, width: int = 16) -> DataFrame:
    """points(file, line) that lie in a range(file, first, last), both ends included: a join on bins of lines."""
    bins = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    p = points.withColumn("bin", F.floor(F.col("line") / width))
    return p.join(bins, ["file", "bin"]).filter("line BETWEEN first AND last").select(*points.columns).distinct()


def similar_search(queries: DataFrame, vectors: DataFrame, ident: str, vector: str, least: float, size: int = 2048) -> DataFrame:
    """(a, b) of query vectors and all other vectors whose dot product is at least `least`.

    Both sides fall into blocks of about `size`; each block of queries meets each block of vectors in one matrix product,
    whose hits are summed again in order.
    """
    some = lambda df: df.select(F.col(ident).alias("id"), F.col(vector).alias("x")).filter("id IS NOT NULL AND x IS NOT NULL")
    q, v = some(queries), some(vectors)
    nq, nv = (max(1, -(-df.count() // size)) for df in (q, v))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("id", "x", F.lit(True).alias("asks"), block(nq).alias("i"), every(nv).alias("j"))
    v = v.select("id", "x", F.lit(False).alias("asks"), every(nq).alias("i"), block(nv).alias("j"))

    def hits(rows):
        left, right = rows[rows["asks"]], rows[~rows["asks"]]
        if left.empty or right.empty:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        x, y = (np.array(side["x"].tolist(), np.float64) for side in (left, right))
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        at, to = np.nonzero(x @ y.T >= least - 1e-6)
        hit = np.array([a[p] != b[q] and np.cumsum(x[p] * y[q])[-1] >= least for p, q in zip(at, to)], bool)
        return pd.DataFrame({"a": a[at[hit]], "b": b[to[hit]]})

    return q.unionByName(v).groupBy("i", "j").applyInPandas(hits, "a long, b long")


def _packed(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, as rows of a matrix, of a block's array of (id, x)."""
    x = items.field("x")
    n = np.unique(pc.list_value_length(x).to_numpy(zero_copy_only=False))
    if len(n) > 1:
        raise ValueError("vectors have different lengths")
    return items.field("id").to_numpy(), x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(items), -1)


def similar_pairs(vectors: DataFrame, ident: str, vector: str, least: float, size: int = 4096) -> DataFrame:
    """(a, b), a < b: all pairs of vectors, of whatever label, whose dot product is at least `least`.

    Vectors fall into blocks of about `size`, a row each; each pair of blocks is a matrix product, some rows of it at a
    time. Only products so near `least` that rounding may decide are summed again in order.
    """
    v = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("x")).filter("id IS NOT NULL AND x IS NOT NULL")
    n = max(1, -(-v.count() // size))
    v = v.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "x")).alias("items"))
    both = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    v = v.select("items", "block", F.explode(both).alias("p")).select("items", "block", "p.i", "p.j")

    def pairs(key, table):
        i, j = (k.as_py() for k in key)
        blocks = {b: _packed(items.values) for b, items in zip(table.column("block").to_pylist(), (s for c in table.column("items").chunks for s in c))}
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if i in blocks and j in blocks:
            (a, x), (b, y) = blocks[i], blocks[j]
            off = 1e-6 * max(1.0, np.linalg.norm(x, axis=1).max() * np.linalg.norm(y, axis=1).max())
            for start in range(0, len(a), 512):
                product = x[start : start + 512] @ y.T
                at, to = np.nonzero(product >= least - off)
                close = product[at, to] < least + off
                at = at + start
                hit = np.ones(len(at), bool)
                hit[close] = np.cumsum(x[at[close]] * y[to[close]], axis=1)[:, -1] >= least
                hit &= a[at] < b[to] if i == j else a[at] != b[to]
                found.append((a[at[hit]], b[to[hit]]))
        a, b = (np.concatenate(side) for side in zip(*found))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return lots(v, "i", "j").groupBy("i", "j").applyInArrow(pairs, "a long, b long")


def handle(author: Column) -> Column:
    """The name that tells a person, in small letters: the part of an address before '@', of a code host's hidden address
    without its number, of a declared owner without its '@'."""
    name = F.regexp_replace(F.lower(author), "^@+", "")
    local = F.substring_index(name, "@", 1)
    return F.when(name.rlike(r"@users\.noreply\."), F.regexp_replace(local, r"^[0-9]+\+", "")).otherwise(local)


def review_routes(changes: DataFrame, declared: DataFrame, reviewer: list[str], bots: list[str]) -> DataFrame:
    """(path, experts, bus_factor_one): whom to ask about each path, never the reviewer, who is known by any of its names.

    declared(path, owner) counts first and alone. Else it is who made most of changes(path, author) and the next two,
    ties by name; those three are taken before the reviewer goes. Authors that a glob of bots matches, by address or by
    the part before '@', make no changes here. A path without changes of others than bots, or with no one left to ask,
    has no row. bus_factor_one: one author made half of the changes or more. Authors of one name in two cases are two.
    """
    local = F.substring_index("author", "@", 1)
    bot = matches_globs(F.col("author"), bots) | matches_globs(local, bots) if bots else F.lit(False)
    n = changes.filter("path IS NOT NULL AND author IS NOT NULL").filter(~bot).groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"))
    most = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "author"))
    n = n.withColumns({"rank": most, "total": F.sum("n").over(Window.partitionBy("path"))}).filter("rank <= 3")
    names = F.array_sort(F.collect_list(F.struct("rank", "author")))["author"]
    asked = n.groupBy("path").agg(names.alias("authors"), (F.max("n") * 2 >= F.max("total")).alias("bus_factor_one"))
    owner = declared.filter("owner IS NOT NULL").groupBy("path").agg(F.max("owner").alias("owner"))
    own = [r.lower().lstrip("@") for r in reviewer]
    mine = lambda x: handle(x).isin(own) | F.regexp_replace(F.lower(x), "^@+", "").isin(own)
    experts = F.filter(F.when(F.col("owner").isNotNull(), F.array("owner")).otherwise(F.col("authors")), lambda x: ~mine(x))
    return asked.join(owner, "path", "left").select("path", experts.alias("experts"), "bus_factor_one").filter("size(experts) > 0")
