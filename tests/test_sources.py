import datetime as dt
import tempfile

from fleetlens.sources import read_landed, write_landed


def test_landed_captures_prune_by_capture_date(spark):
    path = tempfile.mkdtemp(prefix="fleetlens-landed-") + "/waits"
    rows = [(f"srv{i % 3}", dt.datetime(2024, 1, 1 + i % 5, 12), f"W{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "instance_id string, captured_at timestamp_ntz, wait_type string, wait_time_ms long")
    write_landed(df, path, mode="overwrite")
    got = read_landed(spark, path, captured_from=dt.datetime(2024, 1, 3), captured_to=dt.datetime(2024, 1, 4, 23))
    assert sorted(r.wait_type for r in got.collect()) == sorted(f"W{i}" for i in range(50) if i % 5 in (2, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(capture_date" in plan


def test_every_derived_view_matches_its_schema(spark):
    from fleetlens.sources.schemas import TELEMETRY_SCHEMAS, check_schema
    from fleetlens.sources.telemetry import Telemetry
    t = Telemetry(spark, "/root/testdata/sf0.001")
    for name in TELEMETRY_SCHEMAS:
        check_schema(t[name], name)


def test_schema_check_names_the_problem(spark):
    import pytest
    from fleetlens.sources.schemas import check_schema
    df = spark.createDataFrame([("s", "w", 1)], "instance_id string, wait_type string, wait_time_ms int")
    with pytest.raises(ValueError, match="waiting_tasks_count"):
        check_schema(df, "wait_stats")


LANDED_REPORTS = ["top_cpu_statements", "wait_pareto", "wait_delta", "query_delta", "counter_delta", "missing_index_delta", "index_usage_between",
                  "index_row_activity", "row_lock_delta", "index_usage_ledger", "combined_delta_queries", "blocked_sessions", "running_requests",
                  "contended_resources", "idle_open_transactions", "temp_space_by_task", "temp_space_total", "deadlock_events", "locks_held"]


def test_reports_run_unchanged_on_landed_telemetry(spark):
    """Land every table with all its captures, then run the same registered
    reports over the landed copy: same rows."""
    from fleetlens.registry import load_all
    from fleetlens.sources import derive
    from fleetlens.sources.schemas import TELEMETRY_SCHEMAS
    from fleetlens.sources.telemetry import LandedTelemetry, Telemetry
    root = tempfile.mkdtemp(prefix="fleetlens-landed-")
    t = Telemetry(spark, "/root/testdata/sf0.001")
    for name in TELEMETRY_SCHEMAS:
        write_landed(t.captures(name) if name in derive.CAPTURED else t[name], f"{root}/{name}", mode="overwrite")
    landed = LandedTelemetry(spark, root, start=derive.PRE_CAPTURE, end=derive.POST_CAPTURE)
    newest = LandedTelemetry(spark, root)
    for report in LANDED_REPORTS:
        entry = load_all()[report]
        a = sorted(map(tuple, entry.build(t).collect()), key=str)
        assert a == sorted(map(tuple, entry.build(landed).collect()), key=str), report
        assert a or report == "temp_space_by_task", report   # no session over 50 on the smallest tables
    plan = landed.before("wait_stats")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(capture_date" in plan or "PartitionFilters: [capture_date" in plan
    for report in ("top_waits", "blocked_sessions"):
        a = sorted(map(tuple, load_all()[report].build(t).collect()), key=str)
        assert a == sorted(map(tuple, load_all()[report].build(newest).collect()), key=str), report


def test_two_captures_of_one_table_do_not_mix(spark):
    """Reports given a table of two captures report each by its time, as over that capture alone."""
    from pyspark.sql import functions as F

    from fleetlens.plans import inventory, sessions, waits
    from fleetlens.sources.telemetry import Telemetry
    t = Telemetry(spark, "/root/testdata/sf0.001")
    both = t.captures
    texts, dbs = t["sql_texts"], t["databases"]
    blk = ("connections", "requests", "waiting_tasks", "sessions", "session_transactions")
    reports = {
        "top_waits": lambda g: waits.top_waits(g("wait_stats"), n=10**6), "wait_pareto": lambda g: waits.wait_pareto(g("wait_stats")),
        "temp_space_total": lambda g: inventory.temp_space_total(g("file_space_usage")),
        "temp_space_by_kind": lambda g: inventory.temp_space_by_kind(g("file_space_usage")),
        "blocked": lambda g: sessions.blocked_sessions(*[g(n) for n in blk], texts, dbs),
        "blocking": lambda g: sessions.blocking_now(*[g(n) for n in blk[:4]], texts, dbs),
        "requests": lambda g: sessions.running_requests(g("requests"), g("sessions"), texts, t["query_plans"], dbs),
        "idle": lambda g: sessions.idle_open_transactions(g("sessions"), g("session_transactions"), g("connections"), texts, g("requests")),
        "tasks": lambda g: sessions.temp_space_by_task(g("task_space"), g("sessions"), g("connections"), texts, g("requests")),
        "contended": lambda g: sessions.contended_resources(g("locks"), t["objects"], t["partitions"], dbs, g("connections"), texts, g("requests")),
        "locks": lambda g: sessions.locks_held(g("locks"), t["objects"], t["partitions"], dbs),
    }
    for name, report in reports.items():
        got = report(both)
        for at, one in (("2024-01-16 00:00:00", t.before), ("2024-02-01 00:00:00", t.now)):
            a = got.filter(F.col("captured_at") == F.lit(at).cast("timestamp_ntz")).drop("captured_at")
            b = report(one).select(*a.columns)
            assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str), (name, at)


def test_landed_capture_bounds_select_the_capture(spark):
    """A report over a landed table of two captures, bounded to the later
    one, equals the report over that capture alone."""
    from fleetlens.plans import statements as st
    from fleetlens.sources.telemetry import LandedTelemetry, Telemetry
    root = tempfile.mkdtemp(prefix="fleetlens-landed-")
    t = Telemetry(spark, "/root/testdata/sf0.001")
    write_landed(t["query_stats_captures"], f"{root}/query_stats", mode="overwrite")
    landed = LandedTelemetry(spark, root, captured_from="2024-02-01 00:00:00", captured_to="2024-02-01 00:00:00")
    qs = landed["query_stats"]
    assert qs.select("captured_at").distinct().count() == 1
    a = st.most_executed_statements(qs, t["sql_texts"], t["query_plans"], t["databases"]).collect()
    b = st.most_executed_statements(t["query_stats"], t["sql_texts"], t["query_plans"], t["databases"]).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
