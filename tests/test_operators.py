import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import (consecutive_delta, latest_per_key, pareto_cutoff, prefix_overlap, snapshot_delta,
                                 top_n, upsert_ledger)


def test_snapshot_delta_null_safe_keys_and_resets(spark):
    pre = spark.createDataFrame([("a", None, 5), ("a", "x", 10), ("a", "y", 0)], "i string, k string, c long")
    post = spark.createDataFrame([("a", None, 7), ("a", "x", 4), ("a", "y", 3), ("a", "z", 2)],
                                 "i string, k string, c long")
    raw = {(r.k, r.delta_c) for r in snapshot_delta(pre, post, ["i", "k"], ["c"], keep=None, on_reset="raw").collect()}
    assert raw == {(None, 2), ("x", -6), ("y", 3), ("z", 2)}
    cur = {r.k: r.delta_c for r in snapshot_delta(pre, post, ["i", "k"], ["c"], keep=None, on_reset="current").collect()}
    assert cur["x"] == 4
    prev = {r.k: r.delta_c for r in snapshot_delta(pre, post, ["i", "k"], ["c"], keep=None, on_reset="previous").collect()}
    assert prev["x"] == 10
    assert {r.k for r in snapshot_delta(pre, post, ["i", "k"], ["c"], keep="positive", on_reset="raw").collect()} == {
        None, "y", "z"}
    # by default a restarted counter counts from the restart, so it grew
    assert {r.k for r in snapshot_delta(pre, post, ["i", "k"], ["c"], keep="positive").collect()} == {None, "x", "y", "z"}


def test_delta_is_additive_without_reset(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", 5)], "k string, c long")
    b = spark.createDataFrame([("k1", 4), ("k2", 6), ("k3", 1)], "k string, c long")
    c = spark.createDataFrame([("k1", 9), ("k2", 6), ("k3", 8)], "k string, c long")
    ab = {r.k: r.delta_c for r in snapshot_delta(a, b, ["k"], ["c"], keep=None).collect()}
    bc = {r.k: r.delta_c for r in snapshot_delta(b, c, ["k"], ["c"], keep=None).collect()}
    ac = {r.k: r.delta_c for r in snapshot_delta(a, c, ["k"], ["c"], keep=None).collect()}
    assert all(ab.get(k, 0) + bc.get(k, 0) == ac[k] for k in ac)


def test_consecutive_delta_equals_plain_lag(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = [(f"c{rnd.randint(0, 3)}", base + dt.timedelta(seconds=i * 97 + rnd.randint(0, 50)), rnd.randint(0, 1000))
            for i in range(400)]
    df = spark.createDataFrame(rows, "k string, captured_at timestamp_ntz, v long")
    got = {(r.k, r.captured_at): r.delta_value for r in
           consecutive_delta(df, ["k"], "v", bucket="1 hour").collect()}
    w = Window.partitionBy("k").orderBy("captured_at")
    exp = {(r.k, r.captured_at): r.d for r in
           df.select("k", "captured_at", (F.col("v") - F.lag("v").over(w)).alias("d")).collect()}
    assert got == exp


def test_pareto_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([("s", "a", 50), ("s", "b", 30), ("s", "c", 16), ("s", "d", 4)],
                               "instance_id string, w string, v long")
    kept = {r.w for r in pareto_cutoff(df, "v", [F.col("v").desc(), F.col("w")], 95).collect()}
    # before d the running share is 96 % >= 95 %, so d is dropped; c crosses the line and stays
    assert kept == {"a", "b", "c"}


def _brute_overlap(rows):
    out = set()
    for g, i, items in rows:
        a = ", ".join(items)
        for g2, j, items2 in rows:
            b = ", ".join(items2)
            if g == g2 and i != j and (b.startswith(a) or a.startswith(b)):
                if a == ", ".join(items[:len(items)]) and (items2[:len(items)] == items or items[:len(items2)] == items2):
                    out.add((g, i))
    return out


def test_prefix_overlap_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(30):
        for i in range(rnd.randint(1, 6)):
            rows.append((g, f"ix{i}", [rnd.choice(["a ASC", "b DESC", "c ASC"]) for _ in range(rnd.randint(1, 3))]))
    df = spark.createDataFrame(rows, "g int, id string, items array<string>")
    got = {(r.g, r.id) for r in prefix_overlap(df, ["g"], "items", "id").collect()}
    assert got == _brute_overlap(rows)


def test_latest_per_key_and_top_n(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, t int, v string")
    assert {(r.k, r.t, r.v) for r in latest_per_key(df, ["k"], ["t"], ["v"]).collect()} == {("a", 3, "y"), ("b", 2, "z")}
    assert [r.t for r in top_n(df, [F.col("t").desc(), F.col("k")], 2).collect()] == [3, 2]
    assert {(r.k, r.t) for r in top_n(df, [F.col("t").desc()], 1, per=["k"]).collect()} == {("a", 3), ("b", 2)}


def test_ledger_upsert_is_idempotent_for_an_unchanged_capture(spark):
    cap = spark.createDataFrame([("i1", 10, 5, dt.datetime(2024, 1, 1))], "k string, r long, u long, captured_at timestamp_ntz")
    seeded = upsert_ledger(None, cap, ["k"], ["r", "u"])
    again = upsert_ledger(seeded, cap, ["k"], ["r", "u"])
    assert sorted(map(tuple, seeded.collect())) == sorted(map(tuple, again.collect()))
    later = spark.createDataFrame([("i1", 4, 9, dt.datetime(2024, 1, 2))], "k string, r long, u long, captured_at timestamp_ntz")
    row = upsert_ledger(seeded, later, ["k"], ["r", "u"]).first()
    # reads went down (restart): the delta taken is the previous value
    assert (row.current_r, row.last_r, row.diff_r, row.accumulated_r) == (4, 10, 10, 20)
    assert (row.diff_u, row.accumulated_u) == (4, 9)


def test_overlap_is_symmetric_and_pareto_keeps_the_top_row(spark):
    rnd = random.Random(11)
    rows = [(g, f"ix{i}", [rnd.choice(["a ASC", "b ASC"]) for _ in range(rnd.randint(1, 3))])
            for g in range(20) for i in range(rnd.randint(1, 5))]
    df = spark.createDataFrame(rows, "g int, id string, items array<string>")
    hits = {(r.g, r.id) for r in prefix_overlap(df, ["g"], "items", "id").collect()}
    lists = {(g, i): ", ".join(it) for g, i, it in rows}
    for (g, i) in hits:     # every hit has a partner that is a hit too
        partners = [j for (h, j), s in lists.items() if h == g and j != i
                    and (s.startswith(lists[(g, i)]) or lists[(g, i)].startswith(s))]
        assert partners and all((g, j) in hits for j in partners)
    w = spark.createDataFrame([("s", f"w{i}", rnd.randint(1, 1000)) for i in range(40)],
                              "instance_id string, w string, v long")
    top = w.orderBy(F.col("v").desc(), "w").first().w
    for pct in (1, 50, 95):
        kept = {r.w for r in pareto_cutoff(w, "v", [F.col("v").desc(), F.col("w")], pct).collect()}
        assert top in kept


def test_capture_range_delta_equals_two_capture_join(spark):
    from fleetlens.operators import capture_range_delta
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [("a", None, 5, t1), ("a", None, 9, t2), ("b", "x", 4, t1), ("b", "x", 1, t2), ("c", "y", 3, t2),
            ("d", "z", 8, t1)]
    df = spark.createDataFrame(rows, "i string, k string, c long, captured_at timestamp_ntz")
    one = capture_range_delta(df, ["i", "k"], ["c"], t1, t2, keep=None)
    two = snapshot_delta(df.filter(F.col("captured_at") == F.lit("2024-01-01").cast("timestamp_ntz")),
                         df.filter(F.col("captured_at") == F.lit("2024-01-02").cast("timestamp_ntz")),
                         ["i", "k"], ["c"], keep=None)
    cols = ["i", "k", "pre_c", "post_c", "delta_c"]
    assert sorted(map(tuple, one.select(cols).collect()), key=str) == sorted(map(tuple, two.select(cols).collect()), key=str)


def test_latest_capture_per_instance(spark):
    from fleetlens.operators import latest_capture
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([("a", t[0], 1), ("a", t[1], 2), ("b", t[0], 3), ("b", t[2], 4), ("b", t[2], 5)],
                               "instance_id string, captured_at timestamp_ntz, v long")
    assert sorted(r.v for r in latest_capture(df).collect()) == [2, 4, 5]
    assert sorted(r.v for r in latest_capture(df, at="2024-01-02 00:00:00").collect()) == [2, 3]


def test_share_of_total_without_a_key_broadcasts_one_row(spark):
    from fleetlens.operators import share_of_total
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, v long")
    out = share_of_total(df, "v", per=())
    assert sorted((r.k, r._total) for r in out.collect()) == [("a", 4), ("b", 4)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the only nested-loop join allowed: against the broadcast one-row total
    assert "CartesianProduct" not in plan and "BroadcastExchange" in plan


def test_blocking_pairs_stay_inside_an_instance(spark):
    from fleetlens.operators import blocking_pairs
    blocked = spark.createDataFrame([("s1", 10, 5), ("s2", 11, 5)], "instance_id string, session_id int, blocking_session_id int")
    blockers = spark.createDataFrame([("s1", 5, "h1"), ("s3", 5, "h3")], "instance_id string, session_id int, handle string")
    pairs = blocking_pairs(blocked.withColumnRenamed("session_id", "blocked_session_id"), blockers, keys=["instance_id"])
    assert [(r.instance_id, r.blocked_session_id, r.handle) for r in pairs.collect()] == [("s1", 10, "h1")]
