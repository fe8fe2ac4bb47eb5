"""Deltas between two captures: statements (R75), counters (R79), missing
indexes (R80) and their combinations (R81, R82).

``pre`` and ``post`` are two captures of the same landed table; a delta can
be taken between any two captures, per instance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import int_div, statement_slice
from ..operators import database_scope, resolve_handle, resolve_plan, segmented_delta, snapshot_delta
from ..operators.deltas import capture_range_delta
from .constants import (COMBINED_DELTA_SELF_MARK, COMBINED_SLEEP_PATTERN, COMPANION_SELF_TEXT, QUERY_DELTA_SELF_MARK,
                        WAITING_REPORT_SELF_MARK)
from .waits import wait_delta

QUERY_KEYS = ["instance_id", "sql_handle", "plan_handle", "statement_start_offset", "statement_end_offset"]
QUERY_COUNTERS = ["total_elapsed_time", "total_worker_time", "total_logical_reads",
                  "total_logical_writes", "total_clr_time", "execution_count"]


def query_delta(pre: DataFrame, post: DataFrame, texts: DataFrame, plans: DataFrame,
                databases: DataFrame, keys=QUERY_KEYS, database_id=None,
                exclude_prefix: str = QUERY_DELTA_SELF_MARK) -> DataFrame:
    """Duration, CPU, blocked time, reads, writes, CLR time and executions
    of statements that ran between the captures (execution count changed).

    Keys match null-safely (the source's ``ISNULL`` join lets a NULL pre key
    match everything); ``keys`` without ``plan_handle`` gives the variant of
    the combined snapshot report."""
    carry = [k for k in QUERY_KEYS if k not in keys]   # e.g. the plan handle when it is not a key
    d = snapshot_delta(pre, post, keys, QUERY_COUNTERS, keep=None, on_reset="raw", carry=carry)
    return _finish_query_delta(d, texts, plans, databases, database_id, exclude_prefix)


def query_delta_between(captures: DataFrame, start, end, texts: DataFrame, plans: DataFrame,
                        databases: DataFrame, database_id=None,
                        exclude_prefix: str = QUERY_DELTA_SELF_MARK, restarts: DataFrame | None = None) -> DataFrame:
    """R75 over a table of many landed captures: the delta between the
    captures ``start`` and ``end`` in one grouped pass (``capture_range_delta``).  With ``restarts`` (R64's start times) it is
    cut into segments at each server's starts (``segmented_delta``)."""
    if restarts is None:
        d = capture_range_delta(captures, QUERY_KEYS, QUERY_COUNTERS, start, end, keep=None, on_reset="raw")
    else:
        d = segmented_delta(captures, QUERY_KEYS, QUERY_COUNTERS, start, end, restarts, keep=None)
    return _finish_query_delta(d, texts, plans, databases, database_id, exclude_prefix)


def _finish_query_delta(d, texts, plans, databases, database_id, exclude_prefix, exclude_text: str | None = None,
                        with_plan: bool = True) -> DataFrame:
    """Scope, text filter and names of the changed statements.  Narrow joins
    first (plan's database, names), the text where its filter needs it, and
    the plan XML last, so each wide column is moved once.  ``with_plan=False``
    keeps statements whose plan has left the cache, and leaves the plan out."""
    d = d.filter(F.col("delta_execution_count") != 0)
    p = plans.select("instance_id", "plan_handle", "dbid")
    d = database_scope(d.join(p, ["instance_id", "plan_handle"], "inner" if with_plan else "left"), "dbid", database_id)
    db = databases.select("instance_id", F.col("database_id").alias("dbid"), F.col("name").alias("database_name"))
    d = d.join(db, ["instance_id", "dbid"], "left")
    t = texts.select("instance_id", "sql_handle", F.col("text").alias("parent_query"))
    d = resolve_handle(d, t, ["instance_id", "sql_handle"])
    if exclude_prefix:
        d = d.filter(~F.col("parent_query").startswith(exclude_prefix))
    if exclude_text:
        d = d.filter(F.col("parent_query") != exclude_text)
    if with_plan:
        d = resolve_plan(d, plans)
    dur, cpu = F.col("delta_total_elapsed_time"), F.col("delta_total_worker_time")
    return d.select(
        "instance_id", dur.alias("duration"), cpu.alias("cpu_time"), (dur - cpu).alias("blocked_time"),
        F.col("delta_total_logical_reads").alias("reads"), F.col("delta_total_logical_writes").alias("writes"),
        F.col("delta_total_clr_time").alias("clr_time"), F.col("delta_execution_count").alias("executions"),
        statement_slice("parent_query", "statement_start_offset", "statement_end_offset").alias("sql_text"),
        "parent_query", "database_name", *(["query_plan"] if with_plan else []))


def companion_query_delta(pre: DataFrame, post: DataFrame, texts, plans, databases, with_plan: bool = True) -> DataFrame:
    """The statement deltas that R76 (``with_plan``) and R77 show beside theirs: keyed without
    the plan handle, leaving out only the report's own text."""
    keys = [k for k in QUERY_KEYS if k != "plan_handle"]
    d = snapshot_delta(pre, post, keys, QUERY_COUNTERS, keep=None, on_reset="raw", carry=["plan_handle"])
    return _finish_query_delta(d, texts, plans, databases, None, None, exclude_text=COMPANION_SELF_TEXT, with_plan=with_plan)


COUNTER_KEYS = ["instance_id", "object_name", "counter_name", "instance_name"]


def counter_delta(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Initial, final, change and integer % change of counters that rose
    from a non-zero start.  Joined on the counter name too (the source's
    always-true counter condition is not kept)."""
    d = snapshot_delta(pre, post, COUNTER_KEYS, ["cntr_value"], keep=None, on_reset="raw")
    return _risen_counters(d)


def counter_delta_between(captures: DataFrame, start, end, restarts: DataFrame) -> DataFrame:
    """R79 over a table of captures, cut at the servers' starts: ``change`` adds up the segments, so it may differ from final - initial."""
    return _risen_counters(segmented_delta(captures, COUNTER_KEYS, ["cntr_value"], start, end, restarts, keep=None))


def _risen_counters(d: DataFrame) -> DataFrame:
    d = d.filter((F.col("delta_cntr_value") > 0) & (F.col("pre_cntr_value") != 0))
    return d.select(*COUNTER_KEYS, F.col("pre_cntr_value").alias("initial_value"),
                    F.col("post_cntr_value").alias("final_value"), F.col("delta_cntr_value").alias("change"),
                    int_div(F.col("delta_cntr_value") * 100, "pre_cntr_value").alias("pct_change"))


MI_KEYS = ["instance_id", "index_group_handle", "index_handle"]
MI_COUNTERS = ["avg_total_user_cost", "avg_user_impact", "user_seeks", "user_scans"]


def missing_index_delta(pre: DataFrame, post: DataFrame, details: DataFrame) -> DataFrame:
    """Product of the deltas of cost, impact and seeks + scans, rounded;
    rows where any delta is positive, with the index details."""
    return _missing_index_changes(snapshot_delta(pre, post, MI_KEYS, MI_COUNTERS, keep="positive", on_reset="raw"), details)


def missing_index_delta_between(captures: DataFrame, start, end, details: DataFrame, restarts: DataFrame) -> DataFrame:
    """R80 over a table of captures, cut at the servers' starts (the view is empty after one)."""
    return _missing_index_changes(segmented_delta(captures, MI_KEYS, MI_COUNTERS, start, end, restarts, keep="positive"), details)


def _missing_index_changes(d: DataFrame, details: DataFrame) -> DataFrame:
    det = details.select("instance_id", "index_handle", F.col("statement").alias("table_name"),
                         "equality_columns", "inequality_columns", "included_columns")
    d = d.join(det, ["instance_id", "index_handle"])
    cost = F.round(F.col("delta_avg_total_user_cost") * F.col("delta_avg_user_impact")
                   * (F.col("delta_user_seeks") + F.col("delta_user_scans")), 0)
    return d.select("instance_id", cost.alias("total_cost"),
                    F.col("delta_avg_user_impact").alias("avg_user_impact"),
                    F.col("delta_user_seeks").alias("user_seeks"), F.col("delta_user_scans").alias("user_scans"),
                    "table_name", "equality_columns", "inequality_columns", "included_columns")


def combined_delta(pre: dict, post: dict, texts, plans, databases, details) -> dict[str, DataFrame]:
    """The four deltas of one pair of captures.  ``pre``/``post`` map
    ``query_stats``, ``wait_stats``, ``missing_indexes``, ``perf_counters`` to
    DataFrames; persist them first when all four results are computed."""
    return {
        "queries": query_delta(pre["query_stats"], post["query_stats"], texts, plans, databases,
                               keys=[k for k in QUERY_KEYS if k != "plan_handle"],
                               exclude_prefix=COMBINED_DELTA_SELF_MARK),
        "waits": wait_delta(pre["wait_stats"], post["wait_stats"], sleep_pattern=COMBINED_SLEEP_PATTERN),
        "missing_indexes": missing_index_delta(pre["missing_indexes"], post["missing_indexes"], details),
        "counters": counter_delta(pre["perf_counters"], post["perf_counters"]),
    }


def waiting_queries_report(pre: dict, post: dict, texts, plans, databases,
                           samples: DataFrame | None = None) -> dict[str, DataFrame]:
    """Statement deltas (a cached plan is not needed), wait delta, counter delta and the raw
    counter samples of the interval; a reader sorts the statements by blocked time."""
    d = snapshot_delta(pre["query_stats"], post["query_stats"], QUERY_KEYS, QUERY_COUNTERS, keep=None, on_reset="raw")
    out = {
        "queries": _finish_query_delta(d, texts, plans, databases, None, WAITING_REPORT_SELF_MARK, with_plan=False),
        "waits": wait_delta(pre["wait_stats"], post["wait_stats"]),
        "counters": counter_delta(pre["perf_counters"], post["perf_counters"]),
    }
    if samples is not None:
        out["samples"] = samples
    return out


def as_one(parts: dict[str, DataFrame]) -> DataFrame:
    """The parts of a combined report in one table: ``part`` names the part, columns a part lacks are NULL."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("part", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
