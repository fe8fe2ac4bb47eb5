"""Every pipeline stage against a plain version, and the whole run."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from fleetlens.llm import bpe, pii, simhash
from fleetlens.llm.quality_rules import text_stats

SF = "/root/testdata/sf0.001"


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = _rows(docs)

    kept = cp.quality_stage(spark, docs, SF)
    assert kept.columns == columns
    rows = _rows(kept)
    ids = {r["doc_id"] for r in rows}
    for r in before:
        n, _, _, _, rep, *_ = text_stats(r["text"])
        if n < 50 or 100 * rep > 50 * n:
            assert r["doc_id"] not in ids
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    lost = [r for r in before if r["doc_id"] in good - ids and text_stats(r["text"])[0] >= 50]
    assert len(lost) <= 2

    docs = spark.createDataFrame(rows, docs.schema)
    single = cp.near_duplicate_stage(spark, docs, SF)
    assert single.columns == columns
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    rows = _rows(single)
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i in fps if find(i) == i)

    docs = spark.createDataFrame(rows, docs.schema)
    clean = cp.pii_stage(spark, docs, SF)
    assert clean.columns == columns
    texts = {r["doc_id"]: r["text"] for r in rows}
    rows = _rows(clean)
    for r in rows:
        assert r["text"] == pii.redact(texts[r["doc_id"]], pii.find_spans(texts[r["doc_id"]])[1])
        assert r["n_chars"] == len(r["text"])

    docs = spark.createDataFrame(rows, docs.schema)
    mix = cp.mixing_stage(spark, docs, SF)
    assert mix.columns == columns
    size = {r["doc_id"]: len(r["text"].split()) for r in rows}
    rows = _rows(mix)
    copies = Counter(r["doc_id"] for r in rows)
    assert max(copies.values()) <= 2
    assert abs(sum(size[i] * n for i, n in copies.items()) / (1.5 * sum(size.values())) - 1) < 0.2

    last = _rows(cp.encoding_stage(spark, spark.createDataFrame(rows, docs.schema), SF))
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert len(last) == len(rows)
    for r in last:
        assert r["ids"] == ref.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, `_key` string"
    rows = [(1, None, None, None, None, 1, "a"), (1, None, None, None, None, 1, "a"), (None, "", "en", "s", 0, 2, "b"),
            (2, "word " * 30_000, "en", "s", 5, 3, "c"), (3, "mail a@b.co now", None, "t", 15, 4, "d")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
        assert cp.encoding_stage(spark, docs, SF).count() == len(data)


def test_results_of_odd_rows_by_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, `_key` string"
    null, empty = (1, None, None, None, None, 1, "a"), (None, "", "en", "s", 0, 2, "b")
    long, mail = (2, "word " * 30_000, "en", "s", 5, 3, "c"), (3, "mail a@b.co now", None, "t", 15, 4, "d")
    docs = spark.createDataFrame([null, null, empty, long, mail], schema)

    def after(stage):
        return sorted((tuple(r) for r in stage(spark, docs, SF).collect()), key=str)
    assert after(cp.quality_stage) == []                                                  # too short, or one word again and again
    assert after(cp.near_duplicate_stage) == sorted([null, long, mail], key=str)          # texts without a word are one group
    redacted = [null, null, empty, (*long[:4], 150_000, *long[5:]), (3, "mail [EMAIL] now", None, "t", 16, 4, "d")]
    assert after(cp.pii_stage) == sorted(redacted, key=str)
    # source t stops at twice its size, s goes once (half of it again doesn't fit), the one of null texts has no words to take
    assert after(cp.mixing_stage) == sorted([empty, long, mail, mail], key=str)
    got = cp.encoding_stage(spark, docs, SF).select("doc_id", "n_tokens", "decoded_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        ((d, n, hashlib.sha256((t or "").encode()).hexdigest()) for (d, t, *_), n in
         ((null, 0), (null, 0), (empty, 0), (long, 30_001), (mail, 7))), key=str)


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() > 100
