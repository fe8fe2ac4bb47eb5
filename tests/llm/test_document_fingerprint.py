"""Document fingerprints against a version in plain Python, and the order of texts that follow each other."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import document_fingerprint as df_
from fleetlens.llm import queries

SF = "/root/testdata/sf0.01"


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def pieces(text: str) -> list[str]:
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        sentences = [line] if len(line) <= df_.LONG else re.split(r"(?<=[.!?]\s)", line)
        for s in sentences:
            out += [s] if len(s) <= df_.ENDLESS else [s[i:i + df_.PIECE] for i in range(0, len(s), df_.PIECE)]
    return [p for p in out if p]


def tree(text: str) -> tuple[str, list[tuple[str, list[tuple[str, int]]]]]:
    sections: list[list[str]] = []
    for p in pieces(text):
        if not sections or p.startswith("#") or h(p)[0] == "0":
            sections.append([])
        sections[-1].append(p)
    nodes = [(h("".join(h(p) for p in s)), [(h(p)[:16], len(p)) for p in s]) for s in sections]
    return h("".join(d for d, _ in nodes)), nodes


def fingerprint(text: str) -> str:
    root, nodes = tree(text)
    return ";".join([root] + [f"{d[:16]}[{','.join(f'{x}{n}' for x, n in leaves)}]" for d, leaves in nodes])


def likeness(a: str, b: str) -> float:
    (root_a, nodes_a), (root_b, nodes_b) = tree(a), tree(b)
    if root_a == root_b:
        return 1.0
    branch = lambda nodes: {d[:16]: set(leaves) for d, leaves in nodes}
    one, two = branch(nodes_a), branch(nodes_b)
    same = set().union(*(one[d] for d in one.keys() & two.keys()))
    left = set().union(*(v for d, v in one.items() if d not in two))
    right = set().union(*(v for d, v in two.items() if d not in one))
    chars = lambda leaves: sum(n for _, n in leaves)
    return 2.0 * (chars(same) + chars(left & right)) / (2 * chars(same) + chars(left) + chars(right))


def expected(rows: list[tuple]) -> list[tuple]:
    """Rows (id, text) of different ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        out.append((i, len(t), h(edited), fingerprint(t), fingerprint(edited), likeness(t, edited), likeness(t, after)))
    return sorted(out, key=repr)


def run(spark, folder) -> list[tuple]:
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r[c] for c in cols) for r in queries.op11_document_fingerprint(spark, str(folder)).collect()), key=repr)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, SF)
    assert got == expected(rows)
    assert sorted(r[5] for r in got)[len(got) // 2] > 0.4 and sorted(r[6] for r in got)[len(got) // 2] < 0.1


ODD = ["", None, "a", "a", "\n", "\n\n\n", "# Title\npara one\n\npara two.\n# Next\nmore", "x" * 5000, ("word " * 2000).strip(), "ü🙂" * 700 + ". " + "q" * 300,
       "no break but. many! sentences? " * 40, "line\r\nline\r\n", " "]


@pytest.mark.parametrize("block_rows", [1, 2, 5, 1000])
def test_odd_texts_and_any_block_size(spark, tmp_path, monkeypatch, block_rows):
    rows = [(7 * i - 20 if i else None, t, "x", i) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, FOLLOWING string, salt long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    plain = df_.with_following
    monkeypatch.setattr(df_, "with_following", lambda d, i, t: plain(d, i, t, block_rows))
    assert run(spark, tmp_path) == expected([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("rows", [[], [(3, "only. " * 90)], [(None, None)]])
def test_empty_table_and_single_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert run(spark, tmp_path) == expected(rows)


def test_repeated_rows_follow_each_other(spark):
    """Of 300 copies of a row one is followed by the next id's text, all others by themselves, whatever the blocks."""
    docs = spark.createDataFrame([(5, "copy")] * 300 + [(4, "four"), (6, "six"), (6, "sixth")], "id long, text string").repartition(7)
    got = df_.with_following(docs, "id", "text", 16).groupBy("id", "text", "following").count().collect()
    pairs = {(r["id"], r["text"], r["following"]): r["count"] for r in got}
    assert pairs[(5, "copy", "copy")] == 299 and pairs[(5, "copy", "four")] == 1
    sixes = [k for k in pairs if k[0] == 6]
    assert sorted(k[2] for k in sixes) in (["copy", "six"], ["copy", "sixth"]) and sum(pairs.values()) == 303


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i:03}", f"t{i}") for i in range(50)], "id string, text string")
    got = {r["id"]: r["following"] for r in df_.with_following(docs, "id", "text", 4).collect()}
    assert got == {f"d{i:03}": f"t{(i - 1) % 50}" for i in range(50)}


def test_edits_are_located(spark):
    r = random.Random(1)
    rows = []
    for i in range(30):
        lines = [" ".join(f"w{r.randrange(999)}" for _ in range(12)) + "\n" for _ in range(40)]
        k = r.randrange(40)
        rows.append((i, "".join(lines), "".join(lines[:k] + ["changed line\n"] + lines[k + 1:]), sum(map(len, lines[:k])), sum(map(len, lines[:k + 1]))))
    rows.append((30, "same\n", "same\n", 0, 0))
    data = df_.fingerprinted(spark.createDataFrame(rows, "id int, a string, b string, s int, e int"), {"a": "fa", "b": "fb"})
    got = sorted(tuple(x) for x in df_.differences(data, "id", "fa", "fb").select("id", "start", "end").collect())
    assert got == [(x[0], x[3], x[4]) for x in rows[:30]]
    near = df_.with_likeness(data, {"near": ("fa", "fb"), "back": ("fb", "fa")}).select("id", "near", "back").collect()
    assert all(n.near == n.back and (n.near == 1.0 if n.id == 30 else 0.95 < n.near < 1) for n in near)


def test_no_python_in_the_plan(spark):
    plan = queries.op11_document_fingerprint(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_joined_paragraphs_give_the_text_back(spark):
    texts = [t or "" for t in ODD]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_join(df_.paragraphs(F.col("t")), "")).collect()
    assert [r[0] for r in got] == texts
