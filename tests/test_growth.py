"""Steps whose work or memory must not outgrow their input."""

from __future__ import annotations

import datetime as dt
import glob
import re
import tempfile

import pytest

from fleetlens.functions import statement_slice
from fleetlens.operators import joins
from fleetlens.plans import inventory, sessions
from fleetlens.plans import maintenance as mt
from fleetlens.sources import text_index
from fleetlens.streaming import ledger as stl


def test_a_statement_is_cut_from_one_encoding_of_its_batch(spark):
    df = spark.createDataFrame([("SELECT 1; SELECT 2", 20, -1), ("a\U0001f600b", 4, 4), ("ab  ", 0, None), (None, 0, 2)], "t string, s int, e int")
    cut = df.select(statement_slice("t", "s", "e").alias("x"))
    assert [r.x for r in cut.collect()] == ["SELECT 2", "\ufffd", "ab ", None]
    assert cut._jdf.queryExecution().analyzed().toString().lower().count("encode(") == 1


def test_handles_can_be_filtered_by_cheaper_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "_too_large_to_broadcast", lambda df: True)
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 3)], "instance_id string, h int")
    lookup = spark.createDataFrame([("a", 1, "x"), ("c", 3, "y"), ("c", 4, "z")], "instance_id string, h int, text string")
    got = joins.resolve_handle(df, lookup, ["instance_id", "h"], needed=lookup.select("instance_id", "h"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x"), ("a", 1, "x"), ("c", 3, "y")]


def test_locks_are_found_once(spark, monkeypatch):
    filtered = []
    monkeypatch.setattr(joins, "_too_large_to_broadcast", lambda df: True)
    monkeypatch.setattr(joins, "kept_by_keys", lambda lookup, needed, on: filtered.append(set(needed.columns)) or lookup)
    locks = spark.createDataFrame([("s", 1, "KEY", 5, "x", 7, "GRANT", "S"), ("s", 1, "KEY", 5, "x", 8, "WAIT", "X"), ("s", 1, "KEY", 6, "x", 8, "WAIT", "X")],
                                  "instance_id string, resource_database_id int, resource_type string, resource_associated_entity_id long, "
                                  "resource_description string, request_session_id int, request_status string, request_mode string")
    objects = spark.createDataFrame([("s", 1, 9, "t")], "instance_id string, database_id int, object_id int, name string")
    partitions = spark.createDataFrame([("s", 1, 9, 5)], "instance_id string, database_id int, object_id int, partition_id long")
    databases = spark.createDataFrame([("s", 1, "d")], "instance_id string, database_id int, name string")
    connections = spark.createDataFrame([("s", 7, "c7", "h1"), ("s", 8, "c8", "h1"), ("s", None, "c9", "h2")],
                                        "instance_id string, most_recent_session_id int, connection_id string, most_recent_sql_handle string")
    texts = spark.createDataFrame([("s", "h1", "SELECT 1")], "instance_id string, sql_handle string, text string")
    requests = spark.createDataFrame([("s", "c7", 0, -1)], "instance_id string, connection_id string, statement_start_offset int, statement_end_offset int")
    got = sessions.contended_resources(locks, objects, partitions, databases, connections, texts, requests)
    assert sorted((r.request_session_id, r.contending_locks, r.parent_query, r.sql_text, r.resource_type_name) for r in got.collect()) == [
        (7, 1, "SELECT 1", "SELECT 1", "t"), (8, 1, "SELECT 1", None, "t")]
    assert filtered and all("resource_type" not in columns for columns in filtered)   # the texts' filter doesn't run the locks again


def test_contended_locks_meet_no_table_in_a_broadcast(spark):
    locks = spark.createDataFrame([("s", 1, "KEY", 5, "x", 7, "GRANT", "S"), ("s", 1, "KEY", 5, "x", 8, "WAIT", "X"), ("s", 1, "KEY", 5, "x", 8, "WAIT", "X"),
                                   ("s", 2, "OBJECT", 9, None, 7, "WAIT", "X"), ("s", 2, "OBJECT", 9, None, 6, "GRANT", "S"), ("s", 2, "OBJECT", 9, None, 5, "GRANT", "S"),
                                   ("s", 1, "KEY", 6, "x", 8, "WAIT", "X"), ("s", None, "KEY", 5, "x", 7, "GRANT", "S"), ("s", None, "KEY", 5, "x", 8, "WAIT", "S"),
                                   ("s", 3, "PAGE", 5, "y", 8, "GRANT", "S"), ("s", 3, "PAGE", 5, "y", 4, "WAIT", "S")],
                                  "instance_id string, resource_database_id int, resource_type string, resource_associated_entity_id long, "
                                  "resource_description string, request_session_id int, request_status string, request_mode string")
    objects = spark.createDataFrame([("s", 1, 3, "t"), ("s", 2, 9, "u"), ("s", 2, 9, "v")], "instance_id string, database_id int, object_id int, name string")
    partitions = spark.createDataFrame([("s", 1, 3, 5), ("s", 2, 9, 9)], "instance_id string, database_id int, object_id int, partition_id long")
    databases = spark.createDataFrame([("s", 1, "d"), ("s", 2, "e")], "instance_id string, database_id int, name string")
    connections = spark.createDataFrame([("s", 8, "c8", "h1"), ("s", 7, "c7", "h1"), ("s", 6, None, "h2"), ("s", 5, "c5", "h3"), ("s", None, "c9", "h1")],
                                        "instance_id string, most_recent_session_id int, connection_id string, most_recent_sql_handle string")
    texts = spark.createDataFrame([("s", "h1", "SELECT 1; SELECT 2"), ("s", "h2", "SELECT 3")], "instance_id string, sql_handle string, text string")
    requests = spark.createDataFrame([("s", "c8", 20, -1), ("s", "c8", 0, 14), ("s", None, 0, -1)],
                                     "instance_id string, connection_id string, statement_start_offset int, statement_end_offset int")
    got = sessions.contended_resources(locks, objects, partitions, databases, connections, texts, requests)
    rows = [(r.database_name, r.resource_type_name, r.request_session_id, r.request_status, r.sql_text, r.contending_locks, r.holder_session_id, r.waiter_session_id)
            for r in got.collect()]
    assert sorted(rows, key=str) == sorted(
        [("d", "t", 7, "GRANT", None, 2, 7, 8)] + [("d", "t", 8, "WAIT", x, 1, 7, 8) for x in ("SELECT 1", "SELECT 2")] * 2
        + [("e", n, 7, "WAIT", None, 2, 5, 7) for n in "uv"] + [("e", n, 6, "GRANT", None, 1, 5, 7) for n in "uv"]
        + [(None, None, 8, "GRANT", x, 1, 8, 4) for x in ("SELECT 1", "SELECT 2")], key=str)
    joins_run = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert all(re.search(r"BroadcastHashJoin \[id#\d+L\], \[word#\d+L\]", line) for line in joins_run), joins_run   # the words of a key filter, FILTER_BITS / 64


@pytest.mark.parametrize("texts", [["abcde", "xbcd", "", "ab", "cde"], ["a\U0001f600bc\n京", "bc"], ["abc"], []])
def test_grams_of_texts_by_brute_force(texts, monkeypatch):
    import pyarrow as pa
    want = {t[i:i + 4] for t in texts for i in range(len(t) - 3)}
    rows = pa.RecordBatch.from_arrays([pa.array(["f"] * len(texts), pa.string()), pa.array(texts, pa.string())], ["file", "text"])
    for chunk in (1, 3, 1 << 21):
        monkeypatch.setattr(text_index, "CHUNK", chunk)
        assert {g for b in text_index._grams([rows]) for g in b.column(1).to_pylist()} == want


def test_references_are_reduced_by_more_tasks_when_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(inventory, "ROWS_PER_TASK", 10)
    depends = spark.createDataFrame([("s", 1, p, 100 + t) for p in range(5) for t in range(9)] * 2, "instance_id string, database_id int, id long, depid long")
    names = spark.createDataFrame([("s", 1, p, f"p{p}", "P") for p in range(5)] + [("s", 1, 100 + t, f"t{t % 3}", "U") for t in range(9)],
                                  "instance_id string, database_id int, id long, name string, xtype string")
    got = inventory.table_references(depends, names)
    assert sorted((r.proc_name, r.table_name) for r in got.collect()) == sorted((f"p{p}", f"t{t}") for p in range(5) for t in range(3))
    assert got._jdf.queryExecution().optimizedPlan().toString().count(", 10") >= 2   # 90 rows, 10 tasks


def test_the_keys_of_a_batch_are_held_whole_by_no_task(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", 1, 3), ("b", 2, 4), (None, None, None)], "x string, y int, v int")
    batch = spark.createDataFrame([("a", None), ("a", None), (None, None), ("c", 9)], "x string, y int")
    got = stl.touched(rows, batch, ["x", "y"], 3)
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect()), key=str) == [("a", None, 1), ("a", None, 2), (None, None, None)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_more_intervals_are_folded_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(stl, "ROWS_PER_TASK", 10)
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    keys, counters, carry = mt.LEDGER_KEYS, mt.LEDGER_COUNTERS, mt.LEDGER_CARRY
    for day, reads in ((3, 9), (1, 2), (2, 5)):
        rows = [("s", 1, "db", None, "t", f"ix{i}", 1, i, 90, reads * i, i, dt.datetime(2024, 1, day)) for i in range(200)]
        spark.createDataFrame(rows, stl.CAPTURE_SCHEMA).write.mode("append").parquet(f"{base}/landing")
        stl.start_interval_stream(spark, f"{base}/landing", f"{base}/intervals", f"{base}/ckpt", keys, counters, carry).awaitTermination()
    sizes = [[spark.read.parquet(f).count() for f in glob.glob(f"{base}/intervals/delta={b:010d}/*.parquet")] for b in range(3)]
    assert [sum(s) for s in sizes] == [200, 400, 600] and [len(s) > 15 for s in sizes] == [True] * 3
    assert stl.read_intervals(spark, f"{base}/intervals").rdd.getNumPartitions() == 121   # 1,200 rows, 10 in a task
    got = sorted((r.index_id, r.at.day, r.last_read_usage, r.gain_read_usage) for r in stl.read_intervals(spark, f"{base}/intervals").collect())
    assert got == sorted((i, d, i * last, i * gain) for i in range(200) for d, last, gain in ((1, 0, 2), (2, 2, 3), (3, 5, 4)))


def test_stored_references_are_dealt_out_by_their_size_in_files(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="fleetlens-test-")
    spark.range(2000).selectExpr("'s' instance_id", "1 database_id", "id % 50 id", "100 + id % 7 depid").write.parquet(f"{base}/depends")
    depends = spark.read.parquet(f"{base}/depends")
    names = spark.createDataFrame([("s", 1, p, f"p{p}", "P") for p in range(50)] + [("s", 1, 100 + t, f"t{t}", "U") for t in range(7)],
                                  "instance_id string, database_id int, id long, name string, xtype string")
    monkeypatch.setattr(type(depends), "count", lambda self: pytest.fail("a stored table is not counted"))
    small = inventory.table_references(depends, names)
    assert "SinglePartition" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(inventory, "BYTES_PER_TASK", joins.planned_bytes(depends) // 12)
    many = inventory.table_references(depends, names)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Repartition") >= 2
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, small.collect())) and len(many.collect()) == 350
