"""The pipeline on a whole small table: each stage's output, chained, against a plain version of its rule."""

import re

import pandas as pd
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, line_dedup
from tessera.llm.common import Scratch, documents
from tessera.llm.quality import quality_model, score_documents
from tessera.llm.sentencepiece_codec import default_model
from test_corpus_operators import groups, overlaps

from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def chain(spark):
    """(input, output) of each stage by name, as pandas, each stage fed with the one before."""
    folder, scratch, out = "/root/testdata/sf0.001", Scratch(spark, "chain"), {}
    docs = documents(spark, folder)
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.save(stage(spark, docs, folder), name)
        out[name] = docs.toPandas(), after.toPandas()
        docs = after
    return folder, out


def test_quality_stage(spark, chain):
    folder, out = chain
    docs = documents(spark, folder)
    scores = score_documents(docs, quality_model(spark, docs, folder), F.col("doc_id")).toPandas().set_index("row")["score"]
    before, after = out["quality_classifier"]
    assert set(after["doc_id"]) == set(scores.index[scores >= 0.7]) and 0 < len(after) < len(before)
    marks = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id")["quality"]
    good = [i for i in marks.index[marks == 1] if i in set(before["doc_id"])]
    assert sum(i in set(after["doc_id"]) for i in good) >= 0.95 * len(good)


def test_line_stage(chain):
    before, after = chain[1]["line_dedup"]
    earlier, expected = {}, {}
    for row in before.sort_values("doc_id").itertuples():
        stay = []
        for line in (row.text or "").split("\n"):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            near = any(line_dedup.word_edits(w, o, line_dedup.edit_bound(min(len(w), n))) <= line_dedup.edit_bound(min(len(w), n)) for n in range(len(w) - 20, len(w) + 21) for o in earlier.get(n, ())) if w else False
            if not near:
                stay.append(line)
            if w:
                earlier.setdefault(len(w), []).append(w)
        expected[row.doc_id] = "\n".join(stay)
    word = re.compile(r"[^\x20\x09-\x0D]")
    whole = {r.doc_id for r in before.itertuples() if not word.search(r.text or "")}
    expected = {i: t for i, t in expected.items() if i in whole or word.search(t)}
    assert dict(zip(after["doc_id"], after["text"])) == expected
    assert (after["n_chars"] == after["text"].str.len()).all()


def test_jaccard_stage(chain):
    before, after = chain[1]["ngram_jaccard_join"]
    parent = groups([(int(i), t) for i, t in zip(before["doc_id"], before["text"])])
    assert set(after["doc_id"]) == set(parent.values())


def test_decontamination_stage(chain):
    folder, out = chain
    before, after = out["benchmark_decontamination"]
    items = pd.read_parquet(f"{folder}/benchmark.parquet")
    found = overlaps([(int(i), t) for i, t in zip(before["doc_id"], before["text"])], list(zip(items["item_id"], items["text"])))
    plain = {i for i in before["doc_id"]} - {i for i, _ in found}
    # the plain version splits at letters that aren't ASCII, so it may only find more
    assert plain <= set(after["doc_id"]) and decontaminate.MASK_WORDS == 8


def test_encoding_stage(chain):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    before, after = chain[1]["sentencepiece_encoding"]
    text = dict(zip(before["doc_id"], before["text"]))
    assert len(after) == len(before)
    for row in after.itertuples():
        ids = lib.encode(text[row.doc_id] or "")
        assert list(row.ids) == ids and row.n_tokens == len(ids)
        assert b"".join((text[row.doc_id] or "").encode()[a:b] for a, b in zip(row.begins, row.ends)).replace(b" ", b"") == (text[row.doc_id] or "").encode().replace(b" ", b"")


def test_near_copies_are_caught_end_to_end(chain):
    """Of each group of near copies among the documents that quality keeps, one keeps more than a tenth of its text."""
    kept, _ = chain[1]["line_dedup"]
    last, _ = chain[1]["sentencepiece_encoding"]
    parent = groups([(int(i), t) for i, t in zip(kept["doc_id"], kept["text"])])
    copies = [i for i, root in parent.items() if i != root]
    left = {int(i): len(t or "") for i, t in zip(last["doc_id"], last["text"])}
    full = {int(i): len(t or "") for i, t in zip(kept["doc_id"], kept["text"])}
    caught = sum(left.get(i, 0) <= 0.1 * full[i] for i in copies)
    assert copies and caught >= 0.9 * len(copies)
