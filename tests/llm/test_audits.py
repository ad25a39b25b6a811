"""Source divergence, filter interaction and token counts against SQL, brute force and the tokenizers' libraries."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.llm import divergence, filter_audit, token_counts
from tessera.llm.common import Scratch, documents, spread_join

DOCS, LABELS = "doc_id long, text string, lang string, source string, term string, n long, cls string", "doc_id long, quality int, toxic int"


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame) if isinstance(frame, pd.DataFrame) else con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{frame}'")
    return con.sql(sql).df()


def same(got, expected):
    names = sorted(expected.columns)
    assert sorted(got.columns) == names
    rows = lambda f: sorted(map(tuple, f[names].astype(str).values.tolist()))
    assert rows(got) == rows(expected)


def corpus(n=160):
    rng, rows = random.Random(11), []
    words = ["Über", "naïve", "Zoo", "zoo", "漢字", "x1y", "don't", *("abcdefgh"[i % 8] * (i % 3 + 1) for i in range(16))]
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 260])))
        text = rng.choice([text, text, None, "", "same text", "é" * 9, "SHOUT " * 250, "a|b", "\t x \n"])
        rows.append((rng.choice([i, i, i // 2, None]), text, rng.choice(["en", "en", "fr", "", None]), rng.choice([*"abcdefg", "", None]), "?", 1, "?"))
    rows += [(900, None, "xx", "only", "?", 1, "?"), (901, "...", "xx", None, "?", 1, "?")]
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema), pd.DataFrame({c.split()[0]: pd.array([r[k] for r in rows], "string" if "string" in c else "Int64") for k, c in enumerate(schema.split(", "))})


@pytest.mark.parametrize("name, sql", [("op11_divergence", divergence.OP11_SQL), ("op12_filter_audit", filter_audit.OP12_SQL)])
@pytest.mark.parametrize("where", ["edge", "whole"])
def test_audits_match_sql(spark, edge_dir, name, sql, where):
    folder = edge_dir if where == "edge" else "/root/testdata/sf0.001"
    query = getattr(divergence if "11" in name else filter_audit, name)
    got = query(spark, folder).toPandas()
    same(got, by_sql(sql, documents=f"{folder}/documents.parquet", labels=f"{folder}/labels.parquet"))
    assert len(got) > 0 or where == "edge"


def test_divergence_in_many_rounds(spark, monkeypatch):
    """Seven small blocks and several slices a language, tasks that hand on early, texts in pieces; null groups and no terms."""
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "SLICE", 5)
    docs, plain = frame(spark, corpus() * 3)
    got = divergence.divergence(spark, docs, most=40, piece=7).toPandas()
    same(got, by_sql(divergence.OP11_SQL, documents=plain))
    assert (got["value"][got["lang"] == "xx"] == 0).all() and {"pair", "term"} == set(got["part"])


def test_every_pair_of_blocks_meets_once(spark):
    for blocks in range(1, 10):
        frame = spark.createDataFrame([(b, blocks) for b in range(blocks)], "block int, blocks int")
        met = []
        for turn in range(12):
            found = {r["block"]: r["to"] for r in frame.withColumn("to", divergence.partner(frame.block, frame.blocks, turn)).collect()}
            assert all(found[o] == b for b, o in found.items() if o is not None)
            met += [(b, o) for b, o in found.items() if o is not None and o < b]
        assert sorted(met) == [(b, o) for b in range(blocks) for o in range(b)]


def test_shares_are_exact_and_vectors_come_back(spark):
    rows = [(0, 0, 1), (5, 9, 2), (10**15, 10**18, 10**7), (123456789012345678, 923456789012345678, 3)]
    got = spark.createDataFrame(rows, "n long, t long, v long")
    got = got.select("n", "t", "v", divergence.share(got.n, got.t, got.v).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 2) // (r["t"] + 2 * r["v"]) for r in got) and len(got) == len(rows)
    cells = {3: (np.array([0, 4, 9], np.int32), np.array([7, 8, 2**30], np.int32))}
    numbers, shares = divergence.dense(divergence.pack([(1, 5), (3, 6)], cells), 10)
    assert numbers == [1, 3] and shares[0].tolist() == [5] * 10 and shares[1].tolist() == [7, 6, 6, 6, 8, 6, 6, 6, 6, 2**30]
    assert divergence.apart(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18 // (10**9 + 2)]


@pytest.mark.parametrize("digest", [filter_audit.hashed, lambda block: 0, lambda block: len(block) and block[0]])
def test_filter_audit_by_fine_blocks_and_weak_hashes(spark, monkeypatch, digest):
    """Blocks of a few characters; hashes that are equal for different texts, so that full texts decide."""
    monkeypatch.setattr(filter_audit, "MEMBERS", 2)
    docs, plain = frame(spark, [r for r in corpus() if r[0] is None or r[0] % 3 or r[1]])
    labels, marks = frame(spark, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(3, None, 1), (6, 1, None), (None, 1, 1)], LABELS.replace("int", "long"))
    got = filter_audit.audit_filters(spark, docs, labels, reach=[2, 5, 2**31 - 1], digest=digest).toPandas()
    same(got, by_sql(filter_audit.OP12_SQL, documents=plain, labels=marks))
    assert got["redundant"].sum() > 0 and got["good_lost"].sum() > 0 and set(got.groupby("part").size()) == {600}


def test_measures_of_texts():
    texts = ["", None, "Ab Ab c", "é漢字 x", "A|b", " \n", "w " * 300, "a\x1cb\x0bc"]
    for text, (n, blocks, mask, _) in zip(texts, filter_audit.measures(pa.array(texts), reach=[3, 2**31 - 1])):
        text = text or ""
        words = [w for w in text.replace("\n", " ").replace("\x0b", " ").split(" ") if w]
        bits = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text)]
        assert n == len(text) and mask == sum(b << k for k, b in enumerate(bits)), text
        assert blocks == [filter_audit.hashed(x.encode()) for x in ([text] if n <= 3 else [text[:3], text[3:]])]
    body = " ".join(f"w{i % 50}" for i in range(400)).encode()
    assert filter_audit.word_counts(body, 16) == filter_audit.word_counts(body) == (400, 50)


@pytest.mark.parametrize("size", [None, "size"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_without_broadcast(spark, size, how):
    rows = Scratch(spark, "t").save(spark.createDataFrame([(i, i % 7 if i % 2 else 1) for i in range(300)] + [(999, None)], "i int, k int"), "rows")
    values = rows.filter("k < 5").groupBy("k").count().withColumnRenamed("count", "size")
    got = sorted(map(tuple, spread_join(rows, values, "k", size, how=how, few=0, hot=4).select("i", "k", "size").collect()), key=str)
    assert got == sorted(map(tuple, rows.join(values, "k", how).select("i", "k", "size").collect()), key=str) and len(got) > 200


def counts_of(path, texts):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [len(model.encode(t)) for t in texts]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_match_the_library(spark, edge_dir, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    got = token_counts.token_counts(spark, documents(spark, edge_dir), path).toPandas()
    docs = pd.read_parquet(f"{edge_dir}/documents.parquet")
    texts = [t if isinstance(t, str) else "" for t in docs["text"]]
    n = counts_of(path, texts)
    expected = pd.DataFrame({"doc_id": docs["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > 4096 for x in n]})
    rows = lambda f: sorted((-1 if pd.isna(i) else int(i), b, t, o) for i, b, t, o in f[list(expected.columns)].itertuples(index=False))
    assert rows(got) == rows(expected) and max(n) > 4096


@pytest.mark.parametrize("few", [0, 1000])
def test_token_cache_encodes_only_what_it_lacks(spark, monkeypatch, few):
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", few)
    path, asked = token_counts.default_tokenizer(), []
    encode = token_counts.encode_counts
    monkeypatch.setattr(token_counts, "encode_counts", lambda t, p, v: asked.append(sorted(r["content"] for r in t.collect())) or encode(t, p, v))
    first = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, None), (None, "another <s> one")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "one text"), (5, "new words"), (6, "new words"), (7, "")], "doc_id long, text string")
    name = f"tokens_of_test_{few}"
    try:
        for docs in (first, second, second):
            got = token_counts.token_counts(spark, docs, path, cache=name).collect()
            texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
            assert {r["doc_id"]: r["n_tokens"] for r in got} == dict(zip(texts, counts_of(path, list(texts.values()))))
        assert asked == [["", "another <s> one", "one text"], ["new words"], []]
        cache, version = token_counts.TokenCache(spark, name), token_counts.tokenizer_version(path)
        cache.append(cache.counts(version).limit(2), version)  # a second writer had the same misses
        assert cache.counts(version).count() == 4
        cache.append(cache.counts(version).limit(1), "other")
        assert {tuple(r) for r in cache.versions().collect()} == {(version, 4), ("other", 1)} and cache.misses(cache.counts(version), "other").count() == 3
    finally:
        token_counts.TokenCache(spark, name).drop()


def test_another_version_of_a_tokenizer_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([("d", "text")], "text_sha256 string, content string")
    with pytest.raises(Exception, match="differs between the driver and an executor"):
        token_counts.encode_counts(docs, token_counts.default_tokenizer(), "0" * 64).collect()
    with pytest.raises(ValueError, match="a tokenizer is"):
        token_counts.tokenizer_version(str(tmp_path / "model.bin"))
