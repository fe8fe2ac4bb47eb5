"""Streaming forms: restart from the checkpoint and incremental input give
the same result as one run over everything."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import ledger_of_intervals, upsert_ledger
from fleetlens.plans import maintenance as mt
from fleetlens.streaming import counters as stc
from fleetlens.streaming import ledger as stl


def _cap(spark, day, reads):
    rows = [("s", 1, "db", "dbo", "t", f"ix{i}", 1, i, 90, r, 2 * r, day) for i, r in enumerate(reads)]
    return spark.createDataFrame(rows, stl.CAPTURE_SCHEMA)


def test_ledger_stream_incremental_equals_single_run(spark):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    d1, d2 = dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 20)  # two captures of one day
    keys, counters, carry = mt.LEDGER_KEYS, mt.LEDGER_COUNTERS, mt.LEDGER_CARRY
    # run 1: first capture only; run 2: restart from the same checkpoint after the second arrives
    _cap(spark, d1, [5, 7]).write.mode("append").parquet(f"{base}/inc/landing")
    stl.start_ledger_stream(spark, f"{base}/inc/landing", f"{base}/inc/ledger", f"{base}/inc/ckpt",
                            keys, counters, carry).awaitTermination()
    _cap(spark, d2, [9, 3, 4]).write.mode("append").parquet(f"{base}/inc/landing")
    stl.start_ledger_stream(spark, f"{base}/inc/landing", f"{base}/inc/ledger", f"{base}/inc/ckpt",
                            keys, counters, carry).awaitTermination()
    inc = stl.read_ledger(spark, f"{base}/inc/ledger")
    # single run over both captures
    _cap(spark, d1, [5, 7]).write.mode("append").parquet(f"{base}/one/landing")
    _cap(spark, d2, [9, 3, 4]).write.mode("append").parquet(f"{base}/one/landing")
    stl.start_ledger_stream(spark, f"{base}/one/landing", f"{base}/one/ledger", f"{base}/one/ckpt",
                            keys, counters, carry).awaitTermination()
    one = stl.read_ledger(spark, f"{base}/one/ledger")
    assert sorted(map(tuple, inc.collect())) == sorted(map(tuple, one.collect()))
    row = {r.index_name: r for r in inc.collect()}
    assert (row["ix1"].current_read_usage, row["ix1"].diff_read_usage, row["ix1"].accumulated_read_usage) == (3, 7, 14)
    assert row["ix2"].last_read_usage == 0 and row["ix2"].accumulated_read_usage == 4


def test_counter_stream_equals_batch_windows(spark):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", "o", "c", None if i % 3 == 0 else "x", t0 + dt.timedelta(seconds=37 * i), i * i) for i in range(60)]
    df = spark.createDataFrame(rows, stc.SAMPLE_SCHEMA)
    df.filter(F.col("captured_at") < F.lit(t0 + dt.timedelta(minutes=20))).write.parquet(f"{base}/landing/a")
    df.filter(F.col("captured_at") >= F.lit(t0 + dt.timedelta(minutes=20))).write.parquet(f"{base}/landing/b")
    for part in ("a", "b"):   # two arrivals, one restart in between
        os.makedirs(f"{base}/src", exist_ok=True)
        spark.read.parquet(f"{base}/landing/{part}").write.mode("append").parquet(f"{base}/src")
        stc.start_counter_stream(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt").awaitTermination()
    got = sorted(map(tuple, stc.read_counter_windows(spark, f"{base}/out").collect()), key=str)
    exp = sorted(map(tuple, stc.counter_windows(df).collect()), key=str)
    assert got == exp


def test_compacted_windows_equal_the_read_of_all_batches(spark):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", "o", "c", "x", t0 + dt.timedelta(seconds=41 * i), i) for i in range(40)]
    df = spark.createDataFrame(rows, stc.SAMPLE_SCHEMA)
    df.write.parquet(f"{base}/src")
    stc.start_counter_stream(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt").awaitTermination()
    stc.compact_counter_windows(spark, f"{base}/out", f"{base}/compact")
    exp = sorted(map(tuple, stc.read_counter_windows(spark, f"{base}/out").collect()), key=str)
    assert exp and spark.read.parquet(f"{base}/compact").count() == len(exp)
    both = sorted(map(tuple, stc.read_counter_windows(spark, f"{base}/out", f"{base}/compact", 10**9).collect()), key=str)
    assert both == exp


def test_late_samples_count(spark):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    t0 = dt.datetime(2024, 1, 1, 12)
    early = [("s", "o", "c", "x", t0 + dt.timedelta(seconds=30 * i), i) for i in range(10)]
    late = [("s", "o", "c", "x", t0 - dt.timedelta(hours=5) + dt.timedelta(seconds=30 * i), 100 + i) for i in range(10)]
    late.append(("s", "o", "c", "x", t0 - dt.timedelta(seconds=1) + dt.timedelta(seconds=2), 7))   # into an open window
    for part in (early, late):   # the second arrival is five hours older
        spark.createDataFrame(part, stc.SAMPLE_SCHEMA).write.mode("append").parquet(f"{base}/src")
        stc.start_counter_stream(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt").awaitTermination()
    got = stc.read_counter_windows(spark, f"{base}/out")
    exp = stc.counter_windows(spark.createDataFrame(early + late, stc.SAMPLE_SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
    assert got.agg(F.sum("samples")).first()[0] == 21


def test_captures_of_one_batch_are_folded_in_order(spark):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    keys, counters, carry = mt.LEDGER_KEYS, mt.LEDGER_COUNTERS, mt.LEDGER_CARRY
    day = [dt.datetime(2024, 1, 1, h) for h in (6, 12, 18)]
    run = lambda: stl.start_ledger_stream(spark, f"{base}/landing", f"{base}/ledger", f"{base}/ckpt", keys, counters, carry).awaitTermination()
    for at, reads in ((day[1], [50]), (day[0], [5]), (day[1], [50])):   # out of order, and one twice
        _cap(spark, at, reads).write.mode("append").parquet(f"{base}/landing")
    run()
    row = stl.read_ledger(spark, f"{base}/ledger").collect()
    assert len(row) == 1
    assert (row[0].current_read_usage, row[0].last_read_usage, row[0].diff_read_usage, row[0].accumulated_read_usage) == (50, 5, 45, 50)
    assert (row[0].last_modification, row[0].current_modification) == (day[0], day[1])
    _cap(spark, day[0], [999]).write.mode("append").parquet(f"{base}/landing")   # older than the ledger: no change
    _cap(spark, day[2], [20, 3]).write.mode("append").parquet(f"{base}/landing")
    run()
    rows = {r.index_name: r for r in stl.read_ledger(spark, f"{base}/ledger").collect()}
    assert (rows["ix0"].current_read_usage, rows["ix0"].diff_read_usage, rows["ix0"].accumulated_read_usage) == (20, 50, 100)
    assert rows["ix1"].accumulated_read_usage == 3 and len(rows) == 2


def test_an_unreadable_ledger_raises_and_old_versions_go(spark):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    assert stl.read_ledger(spark, f"{base}/ledger") is None
    total = {}
    for k in range(9):   # every batch touches two of four indexes
        rows = [("s", 1, "db", "dbo", "t", f"ix{i}", 1, i, 90, 10 * k + i, k, dt.datetime(2024, 1, 1, k)) for i in (k % 4, (k + 1) % 4)]
        total |= {f"ix{i}": 10 * k + i for i in (k % 4, (k + 1) % 4)}
        spark.createDataFrame(rows, stl.CAPTURE_SCHEMA).write.mode("append").parquet(f"{base}/landing")
        stl.start_ledger_stream(spark, f"{base}/landing", f"{base}/ledger", f"{base}/ckpt", mt.LEDGER_KEYS, mt.LEDGER_COUNTERS,
                                mt.LEDGER_CARRY, compact_every=3).awaitTermination()
    ledger = stl.read_ledger(spark, f"{base}/ledger").collect()
    assert {r.index_name: r.accumulated_read_usage for r in ledger} == total and len(ledger) == 4
    kept = sorted(os.listdir(f"{base}/ledger"))
    assert [f for f in kept if f.startswith("full")] == [f"full={n:010d}" for n in (5, 8)]   # older ones are gone
    assert [f for f in kept if f.startswith("delta")] == [f"delta={n:010d}" for n in range(5, 9)]
    newest = f"{base}/ledger/{kept[-1]}"
    for f in os.listdir(newest):
        if f.endswith(".parquet"):
            with open(f"{newest}/{f}", "wb") as broken:
                broken.write(b"not parquet")
    with pytest.raises(Exception):
        stl.read_ledger(spark, f"{base}/ledger").collect()


def test_a_compacted_copy_knows_which_batches_it_holds(spark):
    """Two batches compacted, a third written after: nothing is lost without naming the bound."""
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", "o", "c", "x", t0 + dt.timedelta(seconds=20 * i), 10 * i) for i in range(9)]

    def arrive(part):
        spark.createDataFrame(part, stc.SAMPLE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/src")
        stc.start_counter_stream(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt").awaitTermination()

    read = lambda *a: sorted(map(tuple, stc.read_counter_windows(spark, f"{base}/out", *a).collect()))
    arrive(rows[:3])
    arrive(rows[3:6])
    stc.compact_counter_windows(spark, f"{base}/out", f"{base}/compact")
    arrive(rows[6:])
    want = sorted(map(tuple, stc.counter_windows(spark.createDataFrame(rows, stc.SAMPLE_SCHEMA)).collect()))
    assert read() == read(f"{base}/compact") == want and want[0][-1] == 9
    stc.compact_counter_windows(spark, f"{base}/out", f"{base}/compact", before_batch=1)   # an older bound is no step back
    assert read(f"{base}/compact") == want
    stc.compact_counter_windows(spark, f"{base}/out", f"{base}/compact")
    assert read(f"{base}/compact") == want
    spark.createDataFrame([], "x int").write.parquet(f"{base}/plain")
    with pytest.raises(ValueError):
        stc.read_counter_windows(spark, f"{base}/out", f"{base}/plain")


def test_a_batch_that_is_being_written_is_not_read(spark):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("s", "o", "c", "x", t0, 5)], stc.SAMPLE_SCHEMA).write.parquet(f"{base}/src")
    stc.start_counter_stream(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt").awaitTermination()
    stc.partial_windows(spark.createDataFrame([("s", "o", "c", "x", t0, 5)], stc.SAMPLE_SCHEMA)).write.parquet(f"{base}/out/batch_id=1")
    os.remove(f"{base}/out/batch_id=1/_SUCCESS")
    assert [r.samples for r in stc.read_counter_windows(spark, f"{base}/out").collect()] == [1]


def test_a_key_with_a_null_part_is_not_seeded_anew(spark):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    keys, counters, carry = mt.LEDGER_KEYS, mt.LEDGER_COUNTERS, mt.LEDGER_CARRY
    for hour, reads in ((1, 5), (2, 50)):
        rows = [("s", 1, "db", None, "t", "ix", 1, 1, 90, reads, reads, dt.datetime(2024, 1, 1, hour))]
        spark.createDataFrame(rows, stl.CAPTURE_SCHEMA).write.mode("append").parquet(f"{base}/landing")
        stl.start_ledger_stream(spark, f"{base}/landing", f"{base}/ledger", f"{base}/ckpt", keys, counters, carry).awaitTermination()
    row, = stl.read_ledger(spark, f"{base}/ledger").collect()
    assert (row.last_read_usage, row.diff_read_usage, row.accumulated_read_usage) == (5, 45, 50)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2), (2, 3, 3, 0, 1, 0)])
def test_intervals_do_not_depend_on_the_order_of_arrival(spark, order):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    keys, counters, carry = mt.LEDGER_KEYS, mt.LEDGER_COUNTERS, mt.LEDGER_CARRY
    caps = [[("s", 1, "db", schema, "t", name, 1, 1, 90, v, 2 * v, dt.datetime(2024, 1, 1 + k)) for name, schema, v in rows]
            for k, rows in enumerate(([("a", "dbo", 10), ("b", None, 4)], [("a", "dbo", 25)], [("a", "dbo", 7), ("b", None, 9), ("c", "x", 1)], [("a", "dbo", 8), ("b", None, 2)]))]
    for k in order:
        spark.createDataFrame(caps[k], stl.CAPTURE_SCHEMA).write.mode("append").parquet(f"{base}/landing")
        stl.start_interval_stream(spark, f"{base}/landing", f"{base}/intervals", f"{base}/ckpt", keys, counters, carry, compact_every=2).awaitTermination()
    intervals = stl.read_intervals(spark, f"{base}/intervals")
    got = sorted(map(tuple, ledger_of_intervals(intervals, keys, counters, carry).collect()), key=str)
    want = upsert_ledger(None, spark.createDataFrame([r for c in caps for r in c], stl.CAPTURE_SCHEMA), keys, counters, carry)
    assert got == sorted(map(tuple, want.collect()), key=str) and len(got) == 3
    spans = sorted((r.index_name, r.gain_read_usage) for r in intervals.collect())
    assert spans == [("a", 1), ("a", 10), ("a", 15), ("a", 25), ("b", 4), ("b", 5), ("b", 9), ("c", 1)]
