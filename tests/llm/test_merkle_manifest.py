"""The Merkle manifest against a recursive version, its SQL and odd rows."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest

from fleetlens.llm import merkle_manifest, queries


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict, more: int = 0) -> str:
    out = []
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[c]
        if c == "n_chars" and v is not None:
            v += more
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*out)


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[bool, str]]]]:
    """Root, and for every node its siblings (on the left?, digest; or nothing) up to it."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    above = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    top, proofs = climb(above)
    out = []
    for i in range(len(nodes)):
        own = [(True, nodes[i - 1])] if i % 2 else [(False, nodes[i + 1])] if i + 1 < len(nodes) else [None]
        out.append(own + proofs[i // 2])
    return top, out


def plain(rows: list[dict]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots, proofs = [], {}
    for g in langs:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        top, proofs[g] = climb([leaf_of(r) for r in groups[g]])
        subroots.append(top)
    if not subroots:
        return []
    root, above = climb(subroots)
    out = []
    for i, g in enumerate(langs):
        for r, proof in zip(groups[g], proofs[g]):
            path = proof + above[i]
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf_of(r, int(changed))
            for s in path:
                now = h(now) if s is None else h(s[1], now) if s[0] else h(now, s[1])
            out.append((r["doc_id"], leaf_of(r), subroots[i], root, h(*[s[1] for s in path if s]), now, now == root))
    return sorted(out, key=repr)


SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in queries.op12_merkle_manifest(spark, str(folder)).collect()), key=repr)


def sql(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return sorted((tuple(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.OP12_SQL})").fetchall()), key=repr)


@pytest.mark.parametrize("sizes", [{"de": 1}, {"de": 2, "en": 1}, {None: 3, "en": 257, "fr": 1, "": 5}, {"a": 511, "b": 512, "c": 513, "é": 2, "z": 1}])
def test_trees_of_many_sizes(spark, tmp_path, sizes):
    rows, n = [], 0
    for lang, count in sizes.items():
        for _ in range(count):
            n += 1
            rows.append(((n * 7919) % 100003, f"text {n % 9} ü", lang, None if n % 11 == 0 else f"s{n % 3}", None if n % 5 == 0 else n))
    got = run(spark, tmp_path, rows)
    assert got == plain([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert got == sql(tmp_path)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "x", "en", "s", 1), (5, "", "en", "", 0), (5, "", "en", "", 0),
            (5, "other", "en", "", 2**63 - 1), (-3, "long " * 50_000, "en", "s", -7), (14, "ten", "de", "s", 3)]
    got = run(spark, tmp_path, [r + ("clash", 1) for r in rows], SCHEMA + ", leaf string, pos long")
    assert got == plain([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_whole_table_and_tampering(spark):
    out = queries.op12_merkle_manifest(spark, SF).collect()
    wrong = {r["doc_id"] for r in out if not r["verified"]}
    assert wrong == {r["doc_id"] for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0} and 0 < len(wrong) < len(out)


def test_text_ids_and_any_change_is_found(spark):
    docs = spark.createDataFrame([(f"doc-{i}", "abc"[i % 3], i) for i in range(40)], "id string, grp string, value int")
    kept = merkle_manifest.manifest(docs, ["id", "grp", "value"], "id", "grp").collect()
    other = docs.replace(17, 18, subset=["value"])
    roots = {r["root"] for r in kept} | {r["root"] for r in merkle_manifest.manifest(other, ["id", "grp", "value"], "id", "grp").collect()}
    assert len(kept) == 40 and len(roots) == 2
