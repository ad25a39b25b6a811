"""Language identification: a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; the probabilities of all positions are averaged to those of the document.
It is trained here, in numpy, by backpropagation through time on windows of a bounded sample of labelled documents.
For scoring, each text is cut into segments whose ends overlap, so that both directions have read some bytes before
the first one that counts, and the segments of a batch run side by side. Every byte counts once, in one map over the
rows, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, slices, small_batches, text_bytes
from .quality import held_out

HIDDEN = 8
#: bytes of a segment that count, and bytes read before and after them
SEGMENT, MARGIN = 240, 8
#: documents of each language that the network is fitted on, those with the smallest hashes of their ids
SAMPLE_PER_LANGUAGE = 300
#: windows a step, their length, and steps
BATCH, WINDOW, STEPS = 192, 48, 260


def _sigmoid(x, out=None):
    out = np.multiply(x, np.float32(0.5), out=out)
    np.tanh(out, out=out)
    out += 1
    out *= np.float32(0.5)
    return out


@dataclass
class Network:
    """p: for direction d, gates zr (e, u, c) and candidate (en, un, cn); output v and o. labels: sorted."""

    p: dict[str, np.ndarray]
    labels: list[str]

    def run(self, x: np.ndarray, d: str, collect) -> None:
        """Reads bytes x (time, row) in the direction and calls collect(t, state) after each."""
        p, n = self.p, x.shape[1]
        h = np.zeros((n, HIDDEN), np.float32)
        eg, en = p[f"eg{d}"] + p[f"cg{d}"], p[f"en{d}"] + p[f"cn{d}"]
        ug, un = p[f"ug{d}"], p[f"un{d}"]
        gates, cand, rh = np.empty((n, 2 * HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            at = x[t]
            np.take(eg, at, axis=0, out=gates, mode="clip")
            gates += h @ ug
            _sigmoid(gates, gates)
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            np.multiply(r, h, out=rh)
            np.take(en, at, axis=0, out=cand, mode="clip")
            cand += rh @ un
            np.tanh(cand, out=cand)
            cand -= h
            cand *= z
            h += cand
            collect(t, h)

    def labelled(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, row, label) of bytes x (time, row)."""
        k = len(self.labels)
        out = np.empty((*x.shape, k), np.float32)
        self.run(x, "f", lambda t, h: np.add(h @ self.p["vf"], self.p["o"], out=out[t]))

        def finish(t, h):
            y = out[t]
            y += h @ self.p["vb"]
            y -= y.max(1, keepdims=True)
            np.exp(y, out=y)
            y /= y.sum(1, keepdims=True)

        self.run(x, "b", finish)
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities (document, label), averaged over the bytes; zeros for an empty text."""
        sizes = np.diff(offsets)
        parts = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(sizes)), parts)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = offsets[doc] + first * SEGMENT
        size = np.minimum(SEGMENT, offsets[doc + 1] - begin)
        sums = np.zeros((len(sizes), len(self.labels)))
        order = np.argsort(size, kind="stable")
        padded = np.concatenate([np.full(MARGIN, 32, np.uint8), data, np.full(SEGMENT + MARGIN, 32, np.uint8)])
        for start in range(0, len(order), 2048):
            some = order[start : start + 2048]
            width = int(size[some].max())
            x = padded[begin[some] + np.arange(width + 2 * MARGIN)[:, None]].astype(np.int32)
            # beyond its document a segment reads spaces, so that a text is scored alike beside any other
            at = begin[some] - MARGIN + np.arange(width + 2 * MARGIN)[:, None]
            x[(at < offsets[doc[some]]) | (at >= offsets[doc[some] + 1])] = 32
            y = self.labelled(x)[MARGIN : MARGIN + width]
            y = np.where((np.arange(width)[:, None] < size[some])[:, :, None], y, 0)
            np.add.at(sums, doc[some], y.sum(0, dtype=np.float64))
        return sums / np.maximum(sizes, 1)[:, None]


def _start(k: int, rng) -> dict[str, np.ndarray]:
    p = {"o": np.zeros(k)}
    for d in "fb":
        p |= {f"eg{d}": rng.normal(0, 0.3, (256, 2 * HIDDEN)), f"en{d}": rng.normal(0, 0.3, (256, HIDDEN))}
        p |= {f"ug{d}": rng.normal(0, 0.3, (HIDDEN, 2 * HIDDEN)), f"un{d}": rng.normal(0, 0.3, (HIDDEN, HIDDEN))}
        p |= {f"cg{d}": np.zeros(2 * HIDDEN), f"cn{d}": np.zeros(HIDDEN), f"v{d}": rng.normal(0, 0.3, (HIDDEN, k))}
    return {n: v.astype(np.float32) for n, v in p.items()}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of every position of x (time, row) with labels y (row), and its gradients."""
    time, n = x.shape
    states, gates, cands = {}, {}, {}
    for d in "fb":
        h, hs = np.zeros((n, HIDDEN), np.float32), np.zeros((time, n, HIDDEN), np.float32)
        g_all, c_all, before = np.zeros((time, n, 2 * HIDDEN), np.float32), np.zeros_like(hs), np.zeros_like(hs)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            before[t] = h
            g = _sigmoid(p[f"eg{d}"][x[t]] + p[f"cg{d}"] + h @ p[f"ug{d}"])
            c = np.tanh(p[f"en{d}"][x[t]] + p[f"cn{d}"] + (g[:, :HIDDEN] * h) @ p[f"un{d}"])
            h = h + g[:, HIDDEN:] * (c - h)
            hs[t], g_all[t], c_all[t] = h, g, c
        states[d], gates[d], cands[d] = (hs, before), g_all, c_all
    logits = states["f"][0] @ p["vf"] + states["b"][0] @ p["vb"] + p["o"]
    logits -= logits.max(-1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(-1, keepdims=True)
    loss = float(-np.log(prob[:, np.arange(n), y] + 1e-9).mean())
    dy = prob
    dy[:, np.arange(n), y] -= 1
    dy /= time * n
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["o"] = dy.sum((0, 1))
    for d in "fb":
        hs, before = states[d]
        grad[f"v{d}"] = np.einsum("tnh,tnk->hk", hs, dy)
        dh, dg_all, dc_all = np.zeros((n, HIDDEN), np.float32), np.zeros_like(gates[d]), np.zeros_like(hs)
        for t in range(time - 1, -1, -1) if d == "f" else range(time):
            dh = dh + dy[t] @ p[f"v{d}"].T
            h0, g, c = before[t], gates[d][t], cands[d][t]
            r, z = g[:, :HIDDEN], g[:, HIDDEN:]
            dc = dh * z * (1 - c * c)
            drh = dc @ p[f"un{d}"].T
            dg = np.concatenate([drh * h0 * r * (1 - r), dh * (c - h0) * z * (1 - z)], 1)
            grad[f"un{d}"] += (r * h0).T @ dc
            grad[f"ug{d}"] += h0.T @ dg
            dg_all[t], dc_all[t] = dg, dc
            dh = dh * (1 - z) + drh * r + dg @ p[f"ug{d}"].T
        grad[f"cg{d}"], grad[f"cn{d}"] = dg_all.sum((0, 1)), dc_all.sum((0, 1))
        np.add.at(grad[f"eg{d}"], x.reshape(-1), dg_all.reshape(-1, 2 * HIDDEN))
        np.add.at(grad[f"en{d}"], x.reshape(-1), dc_all.reshape(-1, HIDDEN))
    return loss, grad


def fit(texts: list[bytes], labels: list[str], steps: int = STEPS) -> Network | None:
    """A network from texts and their labels, each label drawn as often as any other; None without any bytes."""
    rows = [(t, y) for t, y in zip(texts, labels) if t]
    names = sorted({y for _, y in rows})
    if not names:
        return None
    rng = np.random.default_rng(11)
    groups = [[np.frombuffer(t, np.uint8) for t, y in rows if y == name] for name in names]
    p = _start(len(names), rng)
    mean, var = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(len(names), size=BATCH)
        x = np.full((WINDOW, BATCH), 32, np.int32)
        for i, k in enumerate(y):
            text = groups[k][rng.integers(len(groups[k]))]
            at = rng.integers(max(1, len(text) - WINDOW + 1))
            piece = text[at : at + WINDOW]
            x[: len(piece), i] = piece
        _, grad = gradients(p, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1, 1 / (norm + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            var[k] += 0.01 * (g * g - var[k])
            p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network({k: v.astype(np.float32) for k, v in p.items()}, names)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, piece: int = 4096) -> Network | None:
    """A network from docs(doc_id, text, lang); rows without language, id or text are left out.

    Of a sampled text one piece of at most `piece` characters is used, from a place given by the hash of its id. The
    sample is bounded by languages times `per_language` times `piece` characters; every language is learnt, however
    many there are. Rows that repeat an id may be sampled twice; of equal hashes the smaller id comes first. An empty
    table, or one without languages, gives None. Other columns are not read.

    Ids are picked first, by a scan of ids and languages of which each task keeps the first `per_language` rows of a
    language before anything is shuffled; the picked ids are broadcast to find their texts, and the same limit holds
    for the rows found, should an id repeat.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - piece)).cast("int") + 1
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0")
    rows = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.substring(F.col("text"), place, F.lit(piece)).alias("piece"))
    first = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ids = rows.select("lang", "doc_id", "h").withColumn("rank", first("h", "doc_id")).filter(F.col("rank") <= per_language)
    found = rows.join(F.broadcast(ids.select("lang", "doc_id").distinct()), ["lang", "doc_id"])
    found = found.withColumn("rank", first("h", "doc_id", "piece")).filter(F.col("rank") <= per_language)
    sample = found.orderBy("lang", "rank").collect()
    return fit([r["piece"].encode() for r in sample], [r["lang"] for r in sample]) if sample else None


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of docs(doc_id, text): the likeliest label and its averaged probability.

    `und` with score 0 for a null text, one without any letter, or when nothing was learnt. A long text is read whole,
    in segments; repeated rows give repeated results; of equally likely labels the first by name is taken; an empty
    table gives no rows, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                letters = np.array(batch.column("letter").fill_null(False))
                lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
                if net is not None:
                    data, offsets = text_bytes(batch.column("text"))
                    prob = net.documents(data, offsets)
                    best = prob.argmax(1)
                    lang[letters] = np.array(net.labels, object)[best[letters]]
                    score[letters] = np.clip(prob[np.arange(len(best)), best], 0, 1)[letters]
                cols = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document, by a network that hasn't learnt from the rows held out."""
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs.filter(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
