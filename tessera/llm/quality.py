"""Quality classifier: a naive-Bayes support vector machine over character n-grams.

Indicators say that a text has a byte n-gram of length 1 to 4 at least once, twice, four times and so on (pairs and
longer ones are hashed). They are scaled by their class log-count ratios; a linear hinge-loss model is fitted on them
by dual coordinate descent and its margin is turned into a probability. The model is fitted on a bounded sample of
labelled rows; scoring is one map over all rows, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, slices, small_batches, table, text_bytes

#: slots: 16 counts of each of 256 bytes, and 2^17 hashed ones each for pairs, triples and fours with their counts
HASH_BITS = 17
SIZE = 256 * 16 + 3 * (1 << HASH_BITS)
#: labelled rows that a model is fitted on, for each class, the rows with the smallest hashes of their ids; of these,
#: those whose features come within so many bytes, one at least
SAMPLE_PER_CLASS, SAMPLE_BYTES = 2000, 32 << 20
#: a score from which a text is accepted
ACCEPT = 0.7


def indicators(data: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of the bytes of one text; none for an empty text.

    The feature (n-gram, j) is there if the n-gram occurs at least 2^j times, j up to 15.
    """
    b = data.astype(np.uint32)
    grams = [b]
    if len(b) > 1:
        grams.append(b[:-1] << np.uint32(8) | b[1:])
    if len(b) > 2:
        grams.append(b[:-2] << np.uint32(16) | grams[1][1:])
    if len(b) > 3:
        grams.append((grams[2][:-1] * np.uint32(2246822519)) ^ (b[3:] * np.uint32(3266489917)))
    out = []
    for k, gram in enumerate(grams):
        gram, count = np.unique(gram, return_counts=True)
        n = np.minimum(np.log2(count).astype(np.int64), 15) + 1
        gram, j = np.repeat(gram, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if k == 0:
            out.append(gram.astype(np.int64) * 16 + j)
        else:
            h = (gram * np.uint32(668265263) + j.astype(np.uint32) * np.uint32(2654435761)) * np.uint32(2246822519)
            out.append(256 * 16 + ((k - 1) << HASH_BITS) + np.unique(h >> np.uint32(32 - HASH_BITS)).astype(np.int64))
    return np.concatenate(out)


def values(idx: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Feature values: log-count ratios over the root of the number of features."""
    return ratio[idx] / np.sqrt(max(1, len(idx)))


@dataclass
class Model:
    """weight: by feature, log-count ratios included; slope, shift: from margin to log odds; prior: score of no text."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def score(self, idx: np.ndarray) -> float:
        if not len(idx):
            return self.prior
        margin = float(values(idx, self.weight).sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(SIZE, smooth) for _ in range(2)]
    for idx, label in zip(rows, y):
        counts[int(label > 0)][idx] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] + counts[1] - 2 * smooth) < 2] = 0  # seen once: no evidence
    return ratio


def _descend(rows, y, ratio, c: float, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with L2 penalty; the bias is a feature of value 1."""
    rng, w, bias = np.random.default_rng(7), np.zeros(SIZE), 0.0
    # the values are worked out again where they are needed, as they would take twice the memory of the rows
    q = np.array([values(idx, ratio) @ values(idx, ratio) + 1 for idx in rows])
    upper = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    alpha = np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            idx, v = rows[i], values(rows[i], ratio)
            gradient = y[i] * (w[idx] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), upper[i])
            if step := (new - alpha[i]) * y[i]:
                w[idx] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratio, bias


def _platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with smoothed targets and a weak penalty."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        gradient = x.T @ (s - target) + 1e-3 * p
        hessian = (x * (s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        p -= step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(p[0]), 1e-6), float(p[1])


def fit(rows: list[np.ndarray], labels: list[int], prior: float, c: float = 1.0) -> Model:
    """Four fifths of the rows fit the weights; the other fifth fits the curve from margins to probabilities.

    With one class only, or no rows, every text scores the smoothed prior.
    """
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
    if len(set(y)) < 2 or len(y) < 10:
        return Model(np.zeros(SIZE, np.float32), 0.0, 0.0, float(np.log(prior / (1 - prior))), prior)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    train = [r for r, h in zip(rows, held) if not h]
    weight, bias = _descend(train, y[~held], _ratios(train, y[~held]), c)
    test, labels_of = ([r for r, h in zip(rows, held) if h], y[held]) if held.any() else (train, y)
    margin = np.array([values(r, weight).sum() + bias for r in test])
    # classes were sampled evenly: shift the odds back to the prior of all labelled rows
    slope, shift = _platt(margin, labels_of > 0)
    sampled = (y > 0).mean()
    shift += float(np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled)))
    return Model(weight.astype(np.float32), bias, slope, shift, prior)


def _features(batches):
    for batch in (part for whole in batches for part in slices(whole, "text")):
        data, at = text_bytes(batch.column("text"))
        rows = [indicators(data[at[i] : at[i + 1]]).astype(np.int32).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.binary())], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, quality), null labels and ids left out.

    A document with several labels counts as good if their mean is at least 0.5; of rows that repeat an id the
    smallest text is learnt. The prior is counted over all labelled rows; the weights come from at most `per_class`
    whole rows of each class, and of these from as many as SAMPLE_BYTES of features hold, so that long texts can't
    fill the driver. Empty tables give a model without weights. Other columns are not read.
    """
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
    marks = marks.agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    ids = docs.select("doc_id").join(marks, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"))
    ids = ids.withColumn("h", F.xxhash64("doc_id"))
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    prior = (good + 1) / (good + bad + 2)
    picked = [ids.filter(F.col("y") == k).orderBy("h", "doc_id").limit(per_class) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1]).select("doc_id", "y", "h")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", "h", "text")
    sample = sample.groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))
    # a byte begins four n-grams at most, and a feature takes four bytes
    weight = F.least(16 * F.octet_length("text").cast("long"), F.lit(4 * SIZE).cast("long"))
    before = F.sum(weight).over(Window.partitionBy("y").orderBy("h", "doc_id")) - weight
    sample = sample.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") <= SAMPLE_BYTES).select("y", "text")
    rows = sample.mapInArrow(_features, "y int, x binary").toArrow()
    x, y = rows.column("x").combine_chunks(), np.array(rows.column("y"))
    rows = [np.frombuffer(v.as_buffer(), np.int32) for v in x]  # views into one buffer
    order = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), y[i]))  # must not depend on tasks
    order = np.array(order, int)[np.random.default_rng(3).permutation(len(order))]
    return fit([rows[i] for i in order], [int(y[i]) for i in order], prior)


def score_documents(docs: DataFrame, model: Model, payload) -> DataFrame:
    """(row, score): the column `payload` of docs as it is, and the score of its text; null texts score as empty ones.

    Long texts are read whole, repeated rows score alike, an empty table gives no rows.
    """
    rows = docs.select(payload.alias("row"), F.col("text").alias("t"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in (part for whole in batches for part in slices(whole, "t")):
            data, at = text_bytes(batch.column("t"))
            score = [m.score(indicators(data[at[i] : at[i + 1]])) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def held_out(doc_id):
    """Rows that no model learns from: crc32 of the id's text leaves 2 when divided by 4; never a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs.filter(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document, by a model that hasn't learnt from the rows held out."""
    docs = documents(spark, sf_dir)
    out = score_documents(docs, quality_model(spark, docs, sf_dir), F.col("doc_id")).withColumnRenamed("row", "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is at least 0.7, with their columns as they were.

    Null and empty texts score the share of good labels; repeated rows stay or go together; an empty table gives no
    rows, and columns of any name are carried along.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return score_documents(docs, quality_model(spark, docs, sf_dir), row).filter(F.col("score") >= ACCEPT).select("row.*")
