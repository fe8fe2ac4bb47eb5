"""Suffix de-duplication against a table of all 400-byte strings."""

import hashlib
import random
from collections import Counter

import pytest

from fleetlens.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"
L = suffix_dedup.LENGTH


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + L] for r in raws for i in range(len(r) - L + 1))
    out = []
    for r in raws:
        gone, edge = bytearray(len(r)), 0
        for i in range(len(r) - L + 1):
            if seen[r[i:i + L]] > 1:
                for k in range(max(edge, i), i + L):
                    gone[k] = 1
                edge = i + L
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r))), kept))
    return out


def _check(spark, rows, crowded=suffix_dedup.CROWDED):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, g string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                 for r in suffix_dedup.deduplicated(df, crowded=crowded).collect())
    want = sorted((i if i is not None else -1, *b) for (i, _), b in zip(rows, brute([t for _, t in rows])))
    assert got == want


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long_one = text(200), text(900)
    out = [None, "", "x", "a" * 399, "a" * 400, "a" * 401, "b" * 1500, "ab" * 700, passage, passage]
    out += [text(rng.randint(0, 60)) + passage[rng.randint(0, 200):rng.randint(500, len(passage))] + text(rng.randint(0, 60)) for _ in range(40)]
    out += [long_one[:k] + "#" + long_one[k + 1:] for k in (10, 500, 505, 900, 2500)]
    out += [long_one[:1500] + long_one[1000:1700], text(500), text(500), (passage[:300] + "\n") * 3]
    return out


@pytest.mark.parametrize("crowded", [suffix_dedup.CROWDED, 3])
def test_random_copies_and_edges(spark, crowded):
    _check(spark, list(enumerate(_texts())), crowded)


def test_repeated_and_null_ids(spark):
    t = _texts()
    _check(spark, [(1, t[10]), (1, t[10]), (1, t[11]), (None, t[12]), (0, t[12]), (None, t[-2]), (3, t[-3])])


def test_one_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    text = part + "".join(rng.choice("abcdefgh ") for _ in range(20_000)) + part[1000:4000]
    raws = [text.encode(), part.encode()]
    whole = [tuple(map(tuple, x)) for x in suffix_dedup.anchors(raws)]
    monkeypatch.setattr(suffix_dedup, "_FLAT", 3000)
    parts = list(suffix_dedup.anchors(raws))
    starts = lambda rows: sorted((int(w), p) for ws, at, near, far, *_ in rows for w, a, n, f in zip(ws, at, near, far) for p in range(int(a - f), int(a - n) + 1))
    assert starts(whole) == starts(parts) == [(i, p) for i, r in enumerate(raws) for p in range(len(r) - L + 1)]
    _check(spark, [(0, text), (1, part), (2, "other " * 3)])


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: b for r, b in zip(rows, brute([r.text for r in rows]))}
    got = queries.op1_suffix_dedup(spark, SF).collect()
    assert len(got) == len(want) and sum(b[1] for b in want.values()) > 0
    for r in got:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_empty_table(spark):
    assert suffix_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_periodic_text_is_few_rows(spark):
    texts = ["a" * 50_000, "ab c" * 10_000, "x" * 399]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = [suffix_dedup._keys([str(i)], [t.encode()])[0][0] for i, t in enumerate(texts)]
    rows = suffix_dedup.anchor_rows(df, "doc_id", "text").collect()
    assert len(rows) < 20 and sum(r.n for r in rows) > 50_000
    for doc, size in ((0, 50_000), (1, 40_000)):
        starts = [x for r in rows if r._id == key[doc] for x in ([(x.lo, x.hi) for x in r.runs] if r.n > 1 else [(r.a - r.far, r.a - r.near)])]
        assert {p for lo, hi in starts for p in range(lo, hi + 1)} == set(range(size - L + 1))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated(df).collect()}
    assert got == {0: 50_000, 1: 40_000, 2: 0}


def test_null_ids_of_equal_checksum_and_text_ids(spark):
    """Texts of equal CRC-32 under one (null) id keep apart; ids may be of any type."""
    import zlib
    t = _texts()
    a, b = t[10], t[-2]
    free = [f"{b}#{k}" for k in range(3)]
    pairs = {}
    found = None
    rng = random.Random(11)
    while found is None:   # two different tails of equal checksum: about 2**16 tries
        tail = "".join(rng.choice("abcdefgh") for _ in range(12))
        crc = zlib.crc32((a + tail).encode())
        if pairs.setdefault(crc, tail) != tail:
            found = pairs[crc], tail
    one, two = a + found[0], a + found[1]
    assert zlib.crc32(one.encode()) == zlib.crc32(two.encode())
    _check(spark, [(None, one), (None, two), (0, one), (None, free[0]), (7, free[1])])
    rows = [("doc-1", one), ("doc-2", two), (None, one), ("", free[2]), ("null", b)]
    out = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    got = sorted((r.doc_id or "", r.n_removed, r.n_spans, bytes(r.kept)) for r in out)
    assert got == sorted((i or "", *w[1:]) for (i, _), w in zip(rows, brute([x for _, x in rows])))


def test_refine_finds_exactly_the_repeated_strings():
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(700)) for _ in range(4)] + ["ab" * 350, "a" * 500]
    contexts = [(b[:k] + c + b[k + 1:]).encode() for b in base for k, c in ((0, "x"), (350, "y"), (351, "z"), (499, "w"))] + [base[0].encode()] * 2
    seen = Counter(c[i:i + L] for c in contexts for i in range(len(c) - L + 1))
    want = sorted((k, i) for k, c in enumerate(contexts) for i in range(len(c) - L + 1) if seen[c[i:i + L]] > 1)
    context, offset = suffix_dedup.refine(contexts)
    assert sorted(zip(context.tolist(), offset.tolist())) == want
    assert suffix_dedup.refine([b"q" * L])[0].tolist() == []
