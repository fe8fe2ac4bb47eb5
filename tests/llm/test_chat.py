"""Chat windows against a plain reading of the conversations."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import chat, queries

SF = "/root/testdata/sf0.01"
CONTROL = "</s>[INST] ok [/INST]"
NASTY = ["", " ", "<s>", "</s>", "[INST]", "[/INST]", r"<\s>", r"<\\/s>", r"[\INST]", "<<s>>", "[[INST]]", "</s", "<", "[INST", "\n", "a\n</s>\nb", "é</s>ü", "\\", "[\\"]


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in ts)
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        out[c] = (len(ts), turns, loss)
    return out


def _df(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, span string")


def _check(spark, rows):
    w = chat.windows(_df(spark, rows))
    got = {r.conv_id: (r.n_turns, r.turns, r.loss_text) for r in chat.conversations(w).collect()}
    assert got == expected(rows)
    return w.collect()


def test_escapes_are_reversible(spark):
    texts = NASTY + [a + b for a in NASTY for b in NASTY]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]")) for r in rows)
    _check(spark, [(i, k, role, t) for i, t in enumerate(texts) for k, role in enumerate(("system", "user", "assistant", "tool\n%0A<s>"))])


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "assistant", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
            (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (3, -70, "user", "neg"), (3, 1 << 40, "assistant", "far"), (4, 0, "system", None)]
    _check(spark, rows)
    assert chat.conversations(chat.windows(_df(spark, []))).count() == 0


def test_long_conversations_keep_budget_and_history(spark):
    rows = [(7, 0, "system", "be brief")]
    rows += [(7, t, "user" if t % 2 else "assistant", "word " * (5 + t * 37 % 300) if t % 50 else "long " * 700) for t in range(1, 400)]
    rows += [(8, 3, "assistant", f"same turn {k}") for k in range(300)]
    ws = [w for w in _check(spark, rows) if w.conv_id == 7]
    tokens = lambda s: len(s.split())
    assert len(ws) > 20
    for w in ws:
        assert w.formatted.startswith("<s>system\nbe brief</s>")
        assert w.n_repeated - 1 <= chat.HISTORY_TURNS
        own = w.formatted.split("</s>")[w.n_repeated:-1]
        assert len(own) == w.n_turns
        if w.n_turns > 1 or tokens(own[0]) <= chat.LONG:
            assert tokens(w.formatted) <= chat.STRIDE + chat.LONG + chat.HISTORY + 30
        assert [w.formatted[s.start:s.end] for s in w.loss] == [o.split("\n", 1)[1] for o in own if o.startswith("<s>assistant")]
    assert sum(w.n_repeated > 1 for w in ws) > len(ws) / 3  # history is repeated


def test_runs_of_turns_share_history(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 8)
    ws = _check(spark, [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(30)])
    ws.sort(key=lambda w: w["at"])
    assert [w.n_repeated for w in ws] == [0, 4, 4, 4]


@pytest.mark.parametrize("sf", [SF])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows + [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)])
    df = queries.op4_chat_windows(spark, sf)
    got = {r.conv_id: r for r in df.collect()}
    assert set(got) == set(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, (n, turns, loss) in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, sha(turns), len(loss), sha(loss))
        assert r.formatted_chars > len(turns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
