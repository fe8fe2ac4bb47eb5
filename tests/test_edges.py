"""Hand-made telemetry rows for the edge cases of FIXTURES.md section 3."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from fleetlens.plans import deadlocks as dk
from fleetlens.plans import deltas as dl
from fleetlens.plans import inventory as inv
from fleetlens.plans import maintenance as mt
from fleetlens.plans import plancache as pc
from fleetlens.plans import statements as st

NS = 'xmlns="urn:example:showplan"'
QS = ("instance_id string, sql_handle string, plan_handle string, statement_start_offset int, "
      "statement_end_offset int, execution_count long, total_worker_time long, total_elapsed_time long, "
      "total_logical_reads long, total_logical_writes long, total_clr_time long, last_execution_time timestamp_ntz, "
      "plan_generation_num long, creation_time timestamp_ntz")


def _qs(spark, rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([r + (1, t) if len(r) == 12 else r for r in rows], QS)


def test_query_delta_counter_reset_and_new_statement(spark):
    t = dt.datetime(2024, 1, 2)
    pre = _qs(spark, [("s", "h1", "p1", 0, -1, 10, 500, 900, 5, 5, 0, t)])
    post = _qs(spark, [("s", "h1", "p1", 0, -1, 3, 100, 200, 1, 1, 0, t),      # restarted: lower counters
                       ("s", "h2", "p2", 0, 8, 2, 50, 60, 1, 0, 0, t)])        # new statement: pre counts as 0
    texts = spark.createDataFrame([("s", "h1", "select 1"), ("s", "h2", "select 2")], "instance_id string, sql_handle string, text string")
    plans = spark.createDataFrame([("s", "p1", None, "<p/>"), ("s", "p2", 1, "<p/>")], "instance_id string, plan_handle string, dbid int, query_plan string")
    dbs = spark.createDataFrame([("s", 1, "db1")], "instance_id string, database_id int, name string")
    rows = {r.parent_query: r for r in dl.query_delta(pre, post, texts, plans, dbs).collect()}
    assert rows["select 1"].executions == -7 and rows["select 1"].database_name is None   # raw delta, ad hoc
    assert rows["select 2"].duration == 60 and rows["select 2"].database_name == "db1"
    assert rows["select 2"].sql_text == "selec"                                   # (8 - 0) / 2 + 1 characters


def test_database_scope_keeps_adhoc_rows(spark):
    t = dt.datetime(2024, 1, 2)
    qs = _qs(spark, [("s", "h1", "p1", 0, -1, 1, 100, 200, 0, 0, 0, t), ("s", "h2", "p2", 0, -1, 1, 300, 400, 0, 0, 0, t),
                     ("s", "h3", "p3", 0, -1, 1, 500, 600, 0, 0, 0, t)])
    texts = spark.createDataFrame([("s", h, "x") for h in ("h1", "h2", "h3")], "instance_id string, sql_handle string, text string")
    plans = spark.createDataFrame([("s", "p1", None, "<p/>"), ("s", "p2", 1, "<p/>"), ("s", "p3", 2, "<p/>")],
                                  "instance_id string, plan_handle string, dbid int, query_plan string")
    dbs = spark.createDataFrame([("s", 1, "db1")], "instance_id string, database_id int, name string")
    got = sorted(r.total_cpu_s for r in st.top_cpu_statements(qs, texts, plans, dbs, database_id=1).collect())
    assert got == [Decimal("0.00"), Decimal("0.00")]                 # 100 and 300 microseconds, db 1 and ad hoc


def test_top_n_ties_break_on_the_key(spark):
    t = dt.datetime(2024, 1, 2)
    qs = _qs(spark, [("s", f"h{i}", f"p{i}", 0, -1, 5, 100, 200, 0, 0, 0, t) for i in (3, 0, 4, 1, 2)])
    texts = spark.createDataFrame([("s", f"h{i}", f"text {i}") for i in range(5)],
                                  "instance_id string, sql_handle string, text string")
    plans = spark.createDataFrame([("s", f"p{i}", None, "<p/>") for i in range(5)],
                                  "instance_id string, plan_handle string, dbid int, query_plan string")
    dbs = spark.createDataFrame([], "instance_id string, database_id int, name string")
    for _ in range(3):   # every execution count ties: the key decides, the same two rows each time
        out = st.most_executed_statements(qs, texts, plans, dbs, n=2).collect()
        assert sorted(r.parent_query for r in out) == ["text 0", "text 1"]


def test_io_shares_and_latency_with_zero_divisors(spark):
    fs = spark.createDataFrame([("s", 1, 1, 0, 0, 0, 0, 0, 0, 0), ("s", 1, 2, 4, 0, 40, 7, 400, 0, 47)],
                               "instance_id string, database_id int, file_id int, num_of_reads long, num_of_writes long, "
                               "io_stall_read_ms long, io_stall_write_ms long, num_of_bytes_read long, "
                               "num_of_bytes_written long, io_stall long")
    files = spark.createDataFrame([("s", 1, 1, "f1", "c:/a"), ("s", 1, 2, "f2", "C:/b")],
                                  "instance_id string, database_id int, file_id int, name string, physical_name string")
    dbs = spark.createDataFrame([("s", 1, "db1")], "instance_id string, database_id int, name string")
    mix = {r.file_id: r for r in inv.file_io_mix(fs, files, dbs).collect()}
    assert mix[1].io_stall_reads_pct is None and mix[1].reads_pct is None
    assert mix[2].reads_pct == Decimal("100.0")
    lat = inv.disk_latency(fs, files).collect()
    assert len(lat) == 1 and lat[0].disk_drive == "C:" and lat[0].write_latency == 0 and lat[0].read_latency == 10


def test_duplicate_and_prefix_indexes_with_underscore_names(spark):
    tables = spark.createDataFrame([("s", 1, 10, "dbo", "t", False)],
                                   "instance_id string, database_id int, object_id int, schema_name string, table_name string, is_ms_shipped boolean")
    idx = spark.createDataFrame([("s", 1, 10, i, f"ix{i}", "NONCLUSTERED", False) for i in range(1, 6)],
                                "instance_id string, database_id int, object_id int, index_id int, index_name string, type_desc string, is_disabled boolean")
    cols = [(1, 0, "a"), (2, 0, "a"),                  # ix1 == ix2
            (3, 0, "b"), (3, 1, "c"), (4, 0, "b"),     # ix4 is a prefix of ix3
            (5, 0, "b_c")]                             # '_' is literal: 'b_c' is not 'b' + anything
    ic = spark.createDataFrame([("s", 1, 10, i, k, c, False, False) for i, k, c in cols],
                               "instance_id string, database_id int, object_id int, index_id int, key_ordinal int, column_name string, is_descending_key boolean, is_included_column boolean")
    got = {r.index_name for r in mt.duplicate_or_overlapping_indexes(tables, idx, ic).collect()}
    assert got == {"ix1", "ix2", "ix3", "ix4"}


def test_missing_index_groups_none_one_two(spark):
    def plan(groups):
        g = "".join(f'<MissingIndexGroup Impact="{10 * (i + 1)}"><MissingIndex Database="[d]" Schema="[s]" Table="[t]">'
                    f'<ColumnGroup Usage="EQUALITY"><Column Name="[c{i}]"/></ColumnGroup></MissingIndex></MissingIndexGroup>'
                    for i in range(groups))
        mi = f"<MissingIndexes>{g}</MissingIndexes>" if groups else ""
        return (f'<ShowPlanXML {NS}><BatchSequence><Batch><Statements><StmtSimple StatementText="q{groups}">'
                f'<QueryPlan CachedPlanSize="1">{mi}<RelOp Parallel="0"/></QueryPlan></StmtSimple></Statements></Batch>'
                '</BatchSequence></ShowPlanXML>')
    plans = spark.createDataFrame([("s", f"p{k}", plan(k)) for k in range(3)], "instance_id string, plan_handle string, query_plan string")
    counters = pc.STATEMENT_COUNTERS
    qs = spark.createDataFrame([("s", f"p{k}", "h", "ph", None, None, 1) + (1,) * len(counters) for k in range(3)],
                               "instance_id string, plan_handle string, query_hash string, query_plan_hash string, "
                               "creation_time timestamp_ntz, last_execution_time timestamp_ntz, execution_count long, "
                               + ", ".join(f"{c} long" for c in counters))
    out = pc.missing_indexes_from_plans(qs, plans).collect()
    assert sorted(r.plan_handle for r in out) == ["p1", "p2", "p2"]
    assert {r.miss_index_creation for r in out if r.plan_handle == "p1"} == {
        "CREATE NONCLUSTERED INDEX [IX_c0] ON [d].[s].[t](c0) WITH (FILLFACTOR = 90);"}


def test_deadlock_with_two_victims_and_a_process_without_frames(spark):
    ev = ('<event name="xml_deadlock_report" timestamp="2024-01-02T03:04:05.000Z"><data name="xml_report"><value><deadlock>'
          '<victim-list><victimProcess id="p1"/><victimProcess id="p2"/></victim-list><process-list>'
          '<process id="p1"><executionStack><frame sqlhandle="h1" stmtstart="2"/></executionStack></process>'
          '<process id="p2"/></process-list></deadlock></value></data></event>')
    doc = f'<RingBufferTarget eventCount="2">{ev}<event name="other" timestamp="2024-01-02T00:00:00.000Z"/></RingBufferTarget>'
    targets = spark.createDataFrame([("s", "system_health", "ring_buffer", doc)],
                                    "instance_id string, session_name string, target_name string, target_data string")
    texts = spark.createDataFrame([("s", "h1", "abcdef")], "instance_id string, sql_handle string, text string")
    rows = {r.process_id: r for r in dk.deadlock_processes(targets, texts).collect()}
    assert rows["p1"].victim_ids == "p1\\r\\np2" and rows["p1"].sql_text == "bcdef"
    assert rows["p2"].handle is None and rows["p2"].sql_text is None
    counts = dk.deadlock_counts(targets).first()
    assert (counts.ring_buffer_event_count, counts.event_deadlock) == (2, 1)


def test_database_never_restored_keeps_a_row(spark):
    dbs = spark.createDataFrame([("s", "a", None, 150, "c"), ("s", "b", None, 150, "c")],
                                "instance_id string, name string, create_date timestamp_ntz, compatibility_level int, collation_name string")
    r = spark.createDataFrame([("s", 1, "a", dt.datetime(2024, 1, 1), "D"), ("s", 2, "a", dt.datetime(2024, 2, 1), "L")],
                              "instance_id string, restore_history_id long, destination_database_name string, restore_date timestamp_ntz, restore_type string")
    got = {x.database_name: x.restore_history_id for x in inv.latest_restore(dbs, r).collect()}
    assert got == {"a": 2, "b": None}


def test_acknowledged_statements_reset_the_accumulators(spark):
    cap = spark.createDataFrame([("s", 1, "db", "dbo", "t", "ix1", 1, 1, 90, 10, 20, dt.datetime(2024, 1, 1)),
                                 ("s", 1, "db", "dbo", "t", "ix2", 1, 2, 90, 5, 6, dt.datetime(2024, 1, 1))],
                                "instance_id string, database_id int, database_name string, schema_name string, "
                                "table_name string, index_name string, table_id int, index_id int, fill_factor int, "
                                "read_usage long, update_usage long, captured_at timestamp_ntz")
    ledger = mt.index_usage_ledger(None, cap)
    ran = spark.createDataFrame([("s", 1, "db", "dbo", "t", "ix1", "ALTER INDEX [ix1] ON [db].[dbo].[t] REORGANIZE;",
                                  dt.datetime(2024, 1, 1, 3, 0, 0), dt.datetime(2024, 1, 1, 3, 0, 2, 500000))],
                                "instance_id string, database_id int, database_name string, schema_name string, "
                                "table_name string, index_name string, sentence string, start_date timestamp_ntz, "
                                "end_date timestamp_ntz")
    rows = {r.index_name: r for r in mt.acknowledge_maintenance(ledger, ran).collect()}
    assert (rows["ix1"].accumulated_update_usage, rows["ix1"].sentence_counter) == (0, 1)
    assert rows["ix1"].last_sentence.endswith("REORGANIZE;")
    assert (rows["ix2"].accumulated_update_usage, rows["ix2"].sentence_counter, rows["ix2"].last_sentence) == (6, 0, "")
    plan = spark.createDataFrame([("s", "db", "dbo", "t", "ix1"), ("s", "db", "dbo", "t", None)],
                                 "instance_id string, database_name string, schema_name string, table_name string, index_name string")
    runs = {r.index_name: r.duration for r in mt.record_maintenance_runs(plan, ran.drop("database_id", "sentence")).collect()}
    assert runs == {"ix1": 2, None: None}


def test_a_run_in_one_pass_equals_plan_and_acknowledgement(spark):
    at = dt.datetime(2024, 1, 1)
    cap = spark.createDataFrame([("s", 1, "db", "dbo", f"t{k}", f"ix{k}", k, 1, 90, 10, 0 if k == 3 else 20, at) for k in range(1, 9)],
                                "instance_id string, database_id int, database_name string, schema_name string, "
                                "table_name string, index_name string, table_id int, index_id int, fill_factor int, "
                                "read_usage long, update_usage long, captured_at timestamp_ntz")
    ledger = mt.index_usage_ledger(None, cap)
    # 1 rebuild, 2 reorganize, 3 never updated, 4 too small, 5 not fragmented, 6 primary key, 7 without a name, 8 without physical rows
    phys = spark.createDataFrame([("s", 1, k, 1, frag, 50.0, pages) for k, frag, pages in
                                  ((1, 90.0, 2000), (2, 10.0, 2000), (3, 90.0, 2000), (4, 90.0, 10), (5, 1.0, 2000), (6, 90.0, 2000), (7, 90.0, 2000))],
                                 "instance_id string, database_id int, object_id int, index_id int, avg_fragmentation_in_percent double, "
                                 "avg_page_space_used_in_percent double, page_count long")
    ixs = spark.createDataFrame([("s", 1, k, 1, None if k == 7 else f"ix{k}", k == 6) for k in range(1, 9)],
                                "instance_id string, database_id int, object_id int, index_id int, name string, is_primary_key boolean")
    end = dt.datetime(2024, 1, 2)
    key = lambda df: sorted(map(str, df.collect()))
    for only, tables in ((None, {1, 2}), (F.col("table_id") == 2, {2}), (F.lit(None).cast("boolean"), set())):
        plan = mt.index_maintenance_plan(ledger, phys, ixs)
        executed = ledger.select(*mt.LEDGER_KEYS, "table_id").join(plan.select("index_name", "sentence"), "index_name")
        executed = executed.filter(F.lit(True) if only is None else only).withColumn("end_date", F.lit(end).cast("timestamp_ntz"))
        got = mt.run_index_maintenance(ledger, phys, ixs, F.lit(end).cast("timestamp_ntz"), only)
        assert key(got) == key(mt.acknowledge_maintenance(ledger, executed)) and got.count() == 8
        assert {r.table_id for r in got.collect() if r.sentence_counter} == tables
    # several physical rows of one index: the most fragmented one decides, the ledger's row stays one
    twice = phys.unionByName(phys.filter("object_id = 2").withColumn("avg_fragmentation_in_percent", F.lit(31.0)))
    rows = {r.table_id: r for r in mt.run_index_maintenance(ledger, twice, ixs, F.lit(end).cast("timestamp_ntz")).collect()}
    assert len(rows) == 8 and "REBUILD" in rows[2].last_sentence and rows[2].sentence_counter == 1 and rows[8].last_sentence == ""


def test_column_type_conflicts_with_nulls_match_the_pairwise_rule(spark):
    rows = [("s", 1, "dbo", "t1", "id", "int", None, 10, 0),
            ("s", 1, "dbo", "t2", "id", "bigint", None, 19, 0),      # type differs: both id rows conflict
            ("s", 1, "dbo", "t1", "name", "varchar", 50, None, None),
            ("s", 1, "dbo", "t2", "name", "varchar", None, None, None),  # NULL length never differs
            ("s", 1, "dbo", "t3", "code", "char", 3, None, None),
            ("s", 1, "dbo", "t4", "code", "char", 5, None, None),        # length differs
            ("s", 2, "dbo", "t5", "name", "int", None, 10, 0)]            # another database: no conflict
    cols = ("instance_id string, database_id int, table_schema string, table_name string, column_name string, data_type string, "
            "character_maximum_length int, numeric_precision int, numeric_scale int")
    df = spark.createDataFrame(rows, cols)
    got = {(r.table_name, r.column_name) for r in inv.column_type_conflicts(df).collect()}
    # brute force: the source's self join
    exp = set()
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[4] == b[4] and any(x is not None and y is not None and x != y for x, y in zip(a[5:], b[5:])):
                exp.add((a[3], a[4]))
    assert got == exp == {("t1", "id"), ("t2", "id"), ("t3", "code"), ("t4", "code")}
    pct = {r.column_name: r.pct for r in inv.column_type_conflicts(df).collect()}
    assert pct["id"] == Decimal("66.00")     # 2 rows * 100 / 3 names, integer division
