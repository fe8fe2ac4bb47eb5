"""Deltas over whole histories: restarts as boundaries, gaps and new keys, additivity."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from fleetlens.operators import capture_range_delta
from fleetlens.operators.history import counter_gains, gained_between, segmented_delta
from fleetlens.plans import deltas as dl
from fleetlens.plans import waits as wt

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "instance_id string, key string, captured_at timestamp_ntz, c long, d long"


def at(hours: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours)


def _restarts(spark, rows):
    return spark.createDataFrame(rows, "instance_id string, server_start_time timestamp_ntz")


def _plain(rows, starts):
    """Gains one key at a time, in time order."""
    first = {}
    for inst, _, t, *_ in rows:
        first[inst] = min(first.get(inst, t), t)
    out, last = {}, {}
    for inst, key, t, *v in sorted(rows, key=lambda r: r[2]):
        prev = last.get((inst, key))
        segment = sum(s <= t for i, s in starts if i == inst)
        if prev is None:
            gain = [None, None] if t == first[inst] else v
        elif prev[1] != segment:
            gain = v
        else:
            gain = [n if n < p else n - p for n, p in zip(v, prev[2])]
        out[inst, key, t] = (prev[0] if prev else None, *gain)
        last[inst, key] = (t, segment, v)
    return out


def _history(seed):
    """Random counters with gaps, late keys, restarts seen and unseen by the values."""
    r = random.Random(seed)
    rows, starts = [], []
    for inst in ("s1", "s2", "hot"):
        hours = sorted(r.sample(range(0, 200), 30))
        boots = sorted(r.sample(range(0, 200), 3))
        starts += [(inst, at(b + 0.5)) for b in boots]
        for key in ("a", "b", None) if inst != "hot" else tuple("abcdefgh"):
            value, begun = [r.randrange(50), 0], r.random() < 0.4
            for i, h in enumerate(hours):
                if any(hours[i - 1] < b + 0.5 <= h for b in boots) if i else False:
                    value = [0, 0]
                value = [value[0] + r.randrange(100), value[1] + r.randrange(3)]
                begun = begun or r.random() < 0.2
                if begun and r.random() < 0.8:
                    rows.append((inst, key, at(h), *value))
    return rows, starts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gains_equal_a_plain_walk_and_add_up(spark, seed):
    rows, starts = _history(seed)
    captures, keys = spark.createDataFrame(rows, SCHEMA), ["instance_id", "key"]
    gains = counter_gains(captures, keys, ["c", "d"], _restarts(spark, starts), bucket="1 day")
    got = {(r.instance_id, r.key, r.captured_at): (r.prev_captured_at, r.gain_c, r.gain_d) for r in gains.collect()}
    assert got == _plain(rows, starts)
    total = lambda a, b: {(r.instance_id, r.key): r.gain_c or 0 for r in gained_between(gains, keys, ["c"], at(a), at(b)).collect()}
    ab, bc, ac = total(20, 90), total(90, 170), total(20, 170)
    assert ac == {k: ab.get(k, 0) + bc.get(k, 0) for k in ab.keys() | bc.keys()}


def test_a_restart_that_the_values_hide(spark):
    """10 before, 30 after a restart: 30 gained since, not 20; without a restart 20."""
    rows = [("s", "k", at(0), 10, 0), ("s", "k", at(5), 30, 0), ("t", "k", at(0), 10, 0), ("t", "k", at(5), 30, 0)]
    captures, boots = spark.createDataFrame(rows, SCHEMA), _restarts(spark, [("s", at(2)), ("t", at(-1)), ("t", at(6)), ("u", at(2))])
    got = {r.instance_id: (r.pre_c, r.post_c, r.delta_c) for r in segmented_delta(captures, ["instance_id", "key"], ["c"], at(0), at(5), boots).collect()}
    assert got == {"s": (10, 30, 30), "t": (10, 30, 20)}
    assert {r.instance_id: r.gain_c for r in counter_gains(captures, ["instance_id", "key"], ["c"], boots).filter("captured_at > '2024-01-01 01:00:00'").collect()} == {"s": 30, "t": 20}


def test_captures_in_between_keep_what_was_counted_before_a_restart(spark):
    rows = [("s", "k", at(0), 10, 0), ("s", "k", at(3), 100, 0), ("s", "k", at(6), 7, 0), ("s", "new", at(6), 4, 0), ("s", "gone", at(3), 9, 0)]
    captures = spark.createDataFrame(rows, SCHEMA)
    cut = segmented_delta(captures, ["instance_id", "key"], ["c"], at(0), at(6), _restarts(spark, [("s", at(4))]))
    assert {r.key: r.delta_c for r in cut.collect()} == {"k": 97, "new": 4}


def test_segments_without_restarts_equal_the_plain_difference(spark):
    rows, _ = _history(5)
    captures = spark.createDataFrame(rows, SCHEMA)
    times = sorted({r[2] for r in rows if r[0] == "hot"})
    args = (captures, ["instance_id", "key"], ["c", "d"], times[3], times[-2])
    plain = capture_range_delta(*args, on_reset="raw").collect()
    cut = segmented_delta(*args, _restarts(spark, [])).collect()
    assert sorted(map(str, plain)) == sorted(map(str, cut)) and plain


def test_reports_between_captures_start_again_at_a_restart(spark):
    waits = spark.createDataFrame([("s", "W", at(0), 50, 5), ("s", "W", at(9), 80, 6), ("t", "W", at(0), 50, 5), ("t", "W", at(9), 80, 6)],
                                  "instance_id string, wait_type string, captured_at timestamp_ntz, wait_time_ms long, signal_wait_time_ms long")
    boots = _restarts(spark, [("s", at(1))])
    got = {r.instance_id: tuple(r)[2:] for r in wt.wait_delta_between(waits, at(0), at(9), boots).collect()}
    assert got == {"s": (80, 6, 74), "t": (30, 1, 29)}
    counters = spark.createDataFrame([(i, "o", "c", None, at(h), v) for i in "st" for h, v in ((0, 4), (9, 6))],
                                     "instance_id string, object_name string, counter_name string, instance_name string, captured_at timestamp_ntz, cntr_value long")
    got = {r.instance_id: (r.initial_value, r.final_value, r.change, r.pct_change) for r in dl.counter_delta_between(counters, at(0), at(9), boots).collect()}
    assert got == {"s": (4, 6, 6, 150), "t": (4, 6, 2, 50)}


def test_empty_history(spark):
    captures = spark.createDataFrame([], SCHEMA)
    boots = _restarts(spark, [("s", at(1))])
    assert counter_gains(captures, ["instance_id", "key"], ["c"], boots).collect() == []
    assert segmented_delta(captures, ["instance_id", "key"], ["c"], at(0), at(1), boots).collect() == []
