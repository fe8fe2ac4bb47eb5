"""Token alignment against a quadratic version written from its contract."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import queries, token_alignment
from fleetlens.llm.common import written

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(models, texts: list[str | None]) -> list[tuple]:
    """Rows by comparing every token of A with every one of B."""
    a, b = models
    visible = {}
    others = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            visible[chr(byte)] = byte
        else:
            visible[chr(256 + others)] = byte
            others += 1

    def bytes_b(i: int) -> bytes:
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    rows, links = [], []
    for t in texts:
        ids_a = a.encode(f" {t}", add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        raw_a = [bytes(visible[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes_b(i) for i in ids_b]
        if not t or b"".join(raw_a) != f" {t}".encode() or b"".join(raw_b) != f" {t}".encode():
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(r) for r in raw_a]), np.cumsum([len(r) for r in raw_b])
        pairs = np.argwhere(ends_a[:, None] == ends_b[None, :])
        links.append([(ids_a[i], ids_b[j]) for i, j in pairs])
        groups, i0, j0 = [], 0, 0
        for i, j in pairs:
            groups.append(",".join(map(str, ids_a[i0:i + 1])) + "|" + ",".join(map(str, ids_b[j0:j + 1])))
            i0, j0 = i + 1, j + 1
        rows.append((len(ids_a), len(ids_b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    totals = Counter(p for doc in links for p in doc)
    highest: Counter = Counter()
    for (_, j), n in totals.items():
        highest[j] = max(highest[j], n)
    return [r + (sum(totals[p] == highest[p[1]] for p in doc), sum(totals[p] for p in doc)) for r, doc in zip(rows, links)]


SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_query_equals_plain_version(spark, models):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_token_alignment(spark, SF).collect()}
    want = dict(zip([d["doc_id"] for d in docs], plain(models, [d["text"] for d in docs])))
    assert got == want


ODD = [None, "", " ", "a", "a", "a b", "  two  spaces \n\n and\tmore\r\n", "<|endoftext|> <s> </s> <unk> <0x41>", "▁", "x▁y ▁ z", "naïve Ærøskøbing 東京 🙂🙂   ",
       "\x00\x01\x1c\x85", "é" * 50, "́क़ ﬁ ① ½", "word " * 3000, "x" * 5000]


def test_odd_texts(spark, tmp_path, models):
    rows = [(i if i % 5 else None, t, "clash", i) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, N_A string, row_no long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op13_token_alignment(spark, str(tmp_path)).collect())
    assert got == sorted(plain(models, ODD))
    assert got[0] == (0, 0, 0, 0, "", 0, 0)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op13_token_alignment(spark, str(tmp_path)).collect() == []


def test_rare_pairs_meet_their_totals_without_a_broadcast(spark):
    """Whatever number of pairs is broadcast, all links meet their totals."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("PAIRS"))
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        rows, c = token_alignment.aligned(docs, a.read(), b.read())
    assert c["pairs"] != "pairs"
    rows = written(rows.withColumnRenamed(c["pairs"], "p"), "test-rows")
    some = [sorted(map(tuple, token_alignment.corpus_counts(rows, "doc_id", "p", hot=hot).collect())) for hot in (0, 40, 10_000_000)]
    assert some[0] == some[1] == some[2] and len(some[0]) == docs.count()


def test_rank_library_gives_the_tokenizers_ids_for_every_character(models):
    with open(A, encoding="utf-8") as f:
        encode, _ = token_alignment.byte_bpe(f.read())
    texts = [f"a{chr(c)} b{chr(c)}{chr(c)}c  {chr(c)}1" for c in range(1, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    assert [list(x) for x in encode(texts)] == [e.ids for e in models[0].encode_batch([f" {t}" for t in texts], add_special_tokens=False)]


def test_tokens_without_bytes_are_linked_with_their_slice():
    sizes_a, sizes_b = np.array([2, 0, 1, 3, 0]), np.array([2, 4, 0, 0])
    cut_a, cut_b = token_alignment.common_ends(np.cumsum(sizes_a).tolist(), np.cumsum(sizes_b).tolist())
    got = token_alignment.slice_links(sizes_a, sizes_b, np.array(cut_a), np.array(cut_b))
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    assert sorted(zip(*map(np.ndarray.tolist, got))) == sorted((i, j) for i in range(5) for j in range(4) if ends_a[i] == ends_b[j])
