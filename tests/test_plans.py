"""Plan checks and the driver contract on the smallest test tables."""

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and "total_cpu_s" in df.columns


def _batch_queries():
    from fleetlens.registry import load_all
    return sorted(n for n in load_all() if not n.startswith(("stream_", "stored_")))   # those run jobs of their own


@pytest.mark.parametrize("name", _batch_queries())
def test_no_quadratic_operators(spark, name):
    """No cartesian product, no nested-loop join, no single-partition exchange."""
    import __spark_entry__ as e
    plan = _plan(e.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("name", _batch_queries())
def test_no_quadratic_operators_without_broadcasts(spark, name):
    """The shape on tables too large to broadcast: shuffle joins on keys only."""
    import __spark_entry__ as e
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in saved:
            spark.conf.set(k, "-1")
        plan = _plan(e.queries()[name](spark, SF))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    for node in ("CartesianProduct", "NestedLoopJoin", "SinglePartition", "BroadcastHashJoin"):
        assert node not in plan, node


def test_benign_waits_filter_is_a_set_not_a_join(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["top_waits"](spark, SF))
    assert "INSET" in plan.upper() or "IN (" in plan.upper()


def test_every_query_has_an_oracle_or_is_declared(spark):
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_statement_report_ranks_before_attaching_wide_columns(spark):
    """Key-only semi join on the texts; the top-N runs before the text join."""
    import __spark_entry__ as e
    plan = _plan(e.queries()["top_cpu_statements"](spark, SF))
    assert "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<doc_id:bigint>" in plan          # existence check reads the key only
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    # the wide text column is read only outside the subtree that ranks the rows
    lines = plan.splitlines()
    i = next(k for k, line in enumerate(lines) if "TakeOrderedAndProject" in line)
    indent = len(lines[i]) - len(lines[i].lstrip(" :+-"))
    subtree = []
    for line in lines[i + 1:]:
        if len(line) - len(line.lstrip(" :+-")) <= indent:
            break
        subtree.append(line)
    assert subtree and not any("text:string" in line for line in subtree)


def test_per_instance_top_n_uses_a_group_limit(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["top_waits_per_instance"](spark, SF))
    assert "WindowGroupLimit" in plan


def test_latest_restore_is_an_aggregate_not_a_window(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["latest_restore"](spark, SF))
    assert "Window" not in plan and "HashAggregate" in plan


def test_building_a_report_runs_no_spark_job(spark):
    """Reports are lazy plans: building one runs no job of its own (nothing is
    pulled to the driver while the plan is put together).  The only jobs are
    parquet schema discovery of the test tables read without a schema."""
    import __spark_entry__ as e
    sc = spark.sparkContext
    st = sc.statusTracker()
    for name in _batch_queries():
        group = f"build-{name}"
        sc.setJobGroup(group, "build only")
        e.queries()[name](spark, SF)
        stages = [st.getStageInfo(s).name for j in st.getJobIdsForGroup(group) for s in st.getJobInfo(j).stageIds]
        assert all(n.startswith("parquet at ") for n in stages), (name, stages)
    sc.setJobGroup("", "")


_WIDE = ["temp_space_by_session", "temp_space_by_session_detail", "temp_space_by_task", "temp_space_by_task_detail", "running_requests",
         "blocking_now", "blocked_sessions", "blocked_longer_than", "contended_resources", "idle_open_transactions", "deadlock_processes",
         "query_delta", "combined_delta_queries", "waiting_queries_report", "index_row_activity_statements", "row_lock_delta_statements",
         "statements_matching", "statement_locations", "last_table_writes"]


@pytest.mark.parametrize("name", _WIDE)
def test_wide_lookups_are_reduced_in_their_scan(spark, name):
    """On texts too large to broadcast, a text that no kept key (or needle) asks for crosses no exchange; rows stay the same."""
    import __spark_entry__ as e
    want = sorted(map(str, e.queries()[name](spark, SF).collect()))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in saved:
            spark.conf.set(k, "-1")
        df = e.queries()[name](spark, SF)
        lines = _plan(df).splitlines()
        got = sorted(map(str, df.collect()))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert got == want
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    wide = [i for i, line in enumerate(lines) if "FileScan" in line and "text:string" in line]
    assert wide
    for i in wide:
        now, filters = depth(lines[i]), []
        for line in reversed(lines[:i]):   # up to the first exchange above the scan
            if depth(line) < now:
                now = depth(line)
                if "Exchange" in line:
                    break
                filters.append(line)
        assert any("Filter" in f and ("bit_get" in f or "Contains(" in f) for f in filters), lines[i]


def test_a_key_filter_keeps_every_needed_key(spark):
    from fleetlens.operators.joins import kept_by_keys
    lookup = spark.range(200_000).selectExpr("concat('s', id % 7) AS instance_id", "CAST(id AS STRING) AS h")
    needed = lookup.filter("h % 97 = 5").union(spark.sql("SELECT 's1', CAST(NULL AS STRING)"))
    kept = kept_by_keys(lookup, needed, ["instance_id", "h"])
    n = needed.filter("h IS NOT NULL").count()
    assert kept.join(needed, ["instance_id", "h"], "left_semi").count() == n and n <= kept.count() < 1.1 * n
    assert kept_by_keys(lookup, needed.limit(0), ["instance_id", "h"]).count() == 0
