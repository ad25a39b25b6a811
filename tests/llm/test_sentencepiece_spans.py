"""The rows of the query, the stage and encode_documents against the spans of the plain encoder."""

import pandas as pd

from tessera.llm.sentencepiece_codec import codec, default_model, encode_documents, encode_stage, op7_sentencepiece


def test_rows_have_spans(spark, edge_dir):
    docs, own = spark.read.parquet(f"{edge_dir}/documents.parquet"), codec(default_model())
    key = lambda i: -1 if pd.isna(i) else int(i)
    expected = sorted((key(r.doc_id), *own.encode_spans(r.text)) for r in docs.select("doc_id", "text").collect())
    assert any(ids for _, ids, _, _ in expected)
    for rows in (encode_documents(docs), encode_stage(spark, docs, edge_dir)):
        assert sorted((key(r.doc_id), r.ids, r.begins, r.ends) for r in rows.collect()) == expected
    got = op7_sentencepiece(spark, edge_dir).collect()
    assert sorted((key(r.doc_id), r.begins, r.ends) for r in got) == [(i, a, b) for i, _, a, b in expected]
    assert all(r.n_tokens == len(r.begins) for r in got)
