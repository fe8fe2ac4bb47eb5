"""Statement and cached-plan reports.

Shared shape (the reference's ``query_stats CROSS APPLY sql_text CROSS APPLY
query_plan``): filter the statistics, join the narrow plan columns for the
database scope, keep rows whose text exists (a semi join on the handle
only), rank, and attach the wide text / plan / name columns to the ``n``
surviving rows.  Wide columns therefore never cross a shuffle, and the
final joins have a build side bounded by ``n``.  With ``per='instance_id'``
the ranking is per instance instead of fleet-wide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact_ratio, int_div, statement_slice
from ..functions.numeric import rounded_key
from ..functions.text import contains_ci
from ..operators import database_scope, resolve_plan, resolve_text, top_n

QS_KEY = ["instance_id", "plan_handle", "sql_handle", "statement_start_offset", "statement_end_offset"]


def _scoped(qs: DataFrame, plans: DataFrame, texts: DataFrame | None, database_id: int | None,
            adhoc: str = "keep") -> DataFrame:
    """Statistics rows that have a plan and a text, within the database scope.  ``texts=None``
    leaves the text out: the caller joins the texts itself."""
    p = plans.select("instance_id", "plan_handle", "dbid")
    q = qs.join(p, ["instance_id", "plan_handle"])
    if adhoc == "keep":
        q = database_scope(q, "dbid", database_id, keep_adhoc=True)
    elif adhoc == "not_null":       # R42/R43: ``qp.dbid IS NOT NULL``
        q = q.filter(F.col("dbid").isNotNull())
        if database_id is not None:
            q = q.filter(F.col("dbid") == database_id)
    if texts is None:
        return q
    return q.join(texts.select("instance_id", "sql_handle"), ["instance_id", "sql_handle"], "left_semi")


def _decorate(top: DataFrame, plans: DataFrame, texts: DataFrame, databases: DataFrame) -> DataFrame:
    """Attach batch text, plan XML and database name to the ranked rows."""
    d = databases.select("instance_id", F.col("database_id").alias("dbid"), F.col("name").alias("database_name"))
    out = resolve_plan(resolve_text(top, texts, alias="parent_query"), plans)
    out = out.join(d, ["instance_id", "dbid"], "left")
    return out.withColumn("sql_text", statement_slice("parent_query", "statement_start_offset",
                                                      "statement_end_offset"))


def _tiebreak() -> list[Column]:
    return [F.col(k).asc() for k in QS_KEY]


def _time_share_report(qs, texts, plans, databases, metric: Column, metric_name: str,
                       avg_name: str, n: int, database_id, per) -> DataFrame:
    q = _scoped(qs.filter(F.col("total_elapsed_time") > 0), plans, texts, database_id)
    # rank on the seconds rounded to 2 decimals (the source orders by the rounded
    # value) computed in longs; the decimals are built for the n ranked rows only
    q = q.withColumn("_rank", rounded_key(metric, 1000000))
    top = top_n(q, [F.col("_rank").desc()] + _tiebreak(), n, per)
    out = _decorate(top, plans, texts, databases)
    return out.select(
        "instance_id", exact_ratio(metric, F.lit(1000000)).alias(metric_name),
        exact_ratio(F.col("total_worker_time"), F.col("total_elapsed_time"), factor=100).alias("pct_cpu"),
        exact_ratio(F.col("total_elapsed_time") - F.col("total_worker_time"), F.col("total_elapsed_time"),
                    factor=100).alias("pct_waiting"),
        "execution_count",
        exact_ratio(metric, F.lit(1000000) * F.col("execution_count")).alias(avg_name),
        "parent_query", "database_name", "query_plan", "sql_text")


def top_cpu_statements(qs, texts, plans, databases, n: int = 20, database_id=None, per=None):
    """Statements by total CPU seconds, with CPU and waiting shares."""
    return _time_share_report(qs, texts, plans, databases, F.col("total_worker_time"),
                              "total_cpu_s", "avg_cpu_s", n, database_id, per)


def top_duration_statements(qs, texts, plans, databases, n: int = 20, database_id=None, per=None):
    """Statements by total elapsed seconds."""
    return _time_share_report(qs, texts, plans, databases, F.col("total_elapsed_time"),
                              "total_duration_s", "avg_duration_s", n, database_id, per)


def top_blocked_statements(qs, texts, plans, databases, n: int = 20, database_id=None, per=None):
    """Statements by time not spent on CPU (elapsed - worker)."""
    return _time_share_report(qs, texts, plans, databases,
                              F.col("total_elapsed_time") - F.col("total_worker_time"),
                              "total_blocked_s", "avg_blocked_s", n, database_id, per)


def top_io_statements(qs, texts, plans, databases, n: int = 20, database_id=None, per=None):
    """Statements by logical reads + writes; integer average per run."""
    q = _scoped(qs, plans, texts, database_id)
    q = q.withColumn("total_io", F.col("total_logical_reads") + F.col("total_logical_writes"))
    top = top_n(q, [F.col("total_io").desc()] + _tiebreak(), n, per)
    out = _decorate(top, plans, texts, databases)
    return out.select("instance_id", "total_io", int_div("total_io", "execution_count").alias("avg_io"),
                      "execution_count", "parent_query", "database_name", "query_plan", "sql_text")


def most_executed_statements(qs, texts, plans, databases, n: int = 20, database_id=None, per=None):
    """Statements by execution count."""
    q = _scoped(qs, plans, texts, database_id)
    top = top_n(q, [F.col("execution_count").desc()] + _tiebreak(), n, per)
    out = _decorate(top, plans, texts, databases)
    return out.select("instance_id", "execution_count", "parent_query", "database_name", "query_plan",
                      "sql_text")


def most_recompiled_statements(qs, texts, plans, databases, n: int = 20, database_id=None, per=None):
    """Statements by plan generation number (recompilations)."""
    q = _scoped(qs, plans, texts, database_id)
    top = top_n(q, [F.col("plan_generation_num").desc()] + _tiebreak(), n, per)
    out = _decorate(top, plans, texts, databases)
    return out.select("instance_id", "plan_generation_num", "execution_count", "sql_text", "parent_query",
                      "database_name", "creation_time", "last_execution_time")


def statements_last_run(qs, texts, plans, databases, text: str, n: int = 20, database_id=None, per=None):
    """Statements whose *batch* text contains ``text``, oldest last run first."""
    q = _scoped(qs, plans, None, database_id)
    hits = texts.filter(contains_ci("text", text)).select("instance_id", "sql_handle")
    q = q.join(hits, ["instance_id", "sql_handle"], "left_semi")
    top = top_n(q, [F.col("last_execution_time").asc()] + _tiebreak(), n, per)
    out = _decorate(top, plans, texts, databases)
    return out.select("instance_id", "parent_query", "database_name", "query_plan", "last_execution_time")


def _slice_matches(qs, texts, plans, database_id, needles: list[str]) -> DataFrame:
    """Rows whose *statement* (slice of the batch) contains one of ``needles``.

    A slice can only hold a needle that its batch text holds, so the texts are tested first, in their scan, and only
    batches with a needle meet their statements; of those the slice is tested.  Only keys go on to the ranking."""
    def holds(c: Column) -> Column:
        return reduce(lambda a, b: a | b, [contains_ci(c, n) for n in needles])

    q = _scoped(qs, plans, None, database_id)
    t = texts.select("instance_id", "sql_handle", "text")
    if not any("\ufffd" in n for n in needles):   # a cut through a pair of surrogates shows as this, which the batch lacks
        t = t.filter(holds(F.col("text")))
    j = q.join(t, ["instance_id", "sql_handle"])
    j = j.withColumn("_stmt", statement_slice("text", "statement_start_offset", "statement_end_offset"))
    return j.filter(holds(F.col("_stmt"))).drop("text", "_stmt")


def statements_matching(qs, texts, plans, databases, text: str, n: int = 20, database_id=None, per=None):
    """Statements whose statement text contains ``text``, newest first."""
    q = _slice_matches(qs, texts, plans, database_id, [text])
    top = top_n(q, [F.col("last_execution_time").desc()] + _tiebreak(), n, per)
    out = _decorate(top, plans, texts, databases)
    return out.select("instance_id", "last_execution_time", "parent_query", "database_name", "query_plan",
                      "sql_text")


def statement_locations(qs, texts, plans, databases, text: str, n: int = 20, database_id=None, per=None):
    """Where a statement text is used (unordered in the source; ordered by key here)."""
    q = _slice_matches(qs, texts, plans, database_id, [text])
    top = top_n(q, _tiebreak(), n, per)
    out = _decorate(top, plans, texts, databases)
    return out.select("instance_id", "parent_query", "database_name", "query_plan", "sql_text")


def last_table_writes(qs, texts, plans, databases, table: str, n: int = 20, database_id=None, per=None):
    """Statements that INSERT INTO / DELETE / UPDATE ``table``, newest first.

    The statement slice is computed once and tested three times."""
    needles = [f"insert into {table}", f"delete {table}", f"update {table}"]
    q = _slice_matches(qs, texts, plans, database_id, needles)
    top = top_n(q, [F.col("last_execution_time").desc()] + _tiebreak(), n, per)
    out = _decorate(top, plans, texts, databases)
    return out.select("instance_id", "last_execution_time", "sql_text", "parent_query", "query_plan",
                      "database_name", "dbid")


def cached_plans_matching(cached_plans, texts, plans, databases, text: str, n: int = 20, database_id=None,
                          per=None) -> DataFrame:
    """Cached plans whose text contains ``text``; database name falls back
    from the plan's database to the plan attribute's (marked ``*``) to
    'Resource'.  Unordered in the source; ordered by key here."""
    hits = texts.filter(contains_ci("text", text)).select("instance_id", "sql_handle")
    p = database_scope(plans.select("instance_id", "plan_handle", "dbid"), "dbid", database_id)
    cp = cached_plans.select("instance_id", "plan_handle", "sql_handle", "cacheobjtype", "usecounts", "attribute_dbid")
    j = cp.join(hits, ["instance_id", "sql_handle"], "left_semi").join(p, ["instance_id", "plan_handle"])
    top = top_n(j, [F.col("instance_id"), F.col("plan_handle")], n, per)
    d = databases.select("instance_id", "database_id", "name")
    d1 = d.select("instance_id", F.col("database_id").alias("dbid"), F.col("name").alias("_db1"))
    d2 = d.select("instance_id", F.col("database_id").alias("attribute_dbid"), F.col("name").alias("_db2"))
    out = top.join(d1, ["instance_id", "dbid"], "left").join(d2, ["instance_id", "attribute_dbid"], "left")
    out = out.join(texts.select("instance_id", "sql_handle", F.col("text").alias("sql")), ["instance_id", "sql_handle"])
    out = out.join(plans.select("instance_id", "plan_handle", "query_plan"), ["instance_id", "plan_handle"])
    name = F.coalesce(F.col("_db1"), F.concat(F.col("_db2"), F.lit("*")), F.lit("Resource"))
    return out.select("instance_id", "plan_handle", "sql", "cacheobjtype", name.alias("database_name"),
                      F.col("usecounts").alias("plan_usage"), "query_plan")


def _run_history(qs: DataFrame, min_last: int) -> DataFrame:
    """Average of the runs before the last one, the last run's deviation and
    IO (R42/R43 shared columns).  Integer arithmetic as in the source; the
    % deviation is exact: x / ((total - last) / (runs - 1)) = x * (runs - 1) / (total - last)."""
    q = qs.filter((F.col("execution_count") > 1) & (F.col("total_worker_time") != F.col("last_worker_time"))
                  & (F.col("last_worker_time") > min_last))
    prior = F.col("total_worker_time") - F.col("last_worker_time")
    runs1 = F.col("execution_count") - 1
    avg = int_div(prior, runs1)
    dev_num = F.when(F.col("last_worker_time") == 0, F.lit(100)).otherwise(
        (F.col("last_worker_time") - avg) * 100)
    last_io = F.col("last_logical_reads") + F.col("last_logical_writes") + F.col("last_physical_reads")
    total_io = F.col("total_logical_reads") + F.col("total_logical_writes") + F.col("total_physical_reads")
    return q.select(
        "*", F.col("total_worker_time").alias("total_time"), F.col("execution_count").alias("runs"),
        avg.alias("avg_time"), F.col("last_worker_time").alias("last_time"),
        (F.col("last_worker_time") - avg).alias("time_deviation"),
        exact_ratio(dev_num * runs1, prior, scale=6, precision=38).alias("pct_time_deviation"),
        last_io.alias("last_io"), int_div(total_io - last_io, runs1).alias("avg_io"))


_HISTORY_COLS = ["runs", "avg_time", "last_time", "time_deviation", "pct_time_deviation", "last_io", "avg_io"]


def longest_statements(qs, texts, plans, databases, n: int = 100, by: str = "total", min_last: int = 0,
                       per=None) -> DataFrame:
    """Statements by total CPU (``by='total'``) or by average CPU of the
    runs before the last (``by='avg'``), with the last run's deviation and IO.
    The source keeps only plans of a named database (``dbid IS NOT NULL``)."""
    q = _scoped(_run_history(qs, min_last), plans, texts, None, adhoc="not_null")
    key = "total_time" if by == "total" else "avg_time"
    top = top_n(q, [F.col(key).desc()] + _tiebreak(), n, per)
    out = _decorate(top, plans, texts, databases)
    return out.select("instance_id", "total_time", *_HISTORY_COLS, "sql_text", "parent_query", "query_plan",
                      "database_name")


def slower_than_usual(qs, texts, plans, databases, n: int = 100, impedance: int = 20, min_last: int = 0,
                      database_id=None) -> DataFrame:
    """Three chained stages, each keeping its top ``n``: by % time
    deviation (descending), then by it ascending with the IO deviation added,
    then rows whose |time %| - |IO %| exceeds ``impedance``, by impedance.

    Every stage works on the ``n`` rows of the one before (the first is a
    TakeOrderedAndProject), so only the first touches the whole table."""
    q = _scoped(_run_history(qs, min_last), plans, texts, database_id)
    s1 = top_n(q, [F.col("pct_time_deviation").desc()] + _tiebreak(), n)
    io_dev = F.col("last_io") - F.col("avg_io")
    s2 = s1.withColumn("io_deviation", io_dev).withColumn(
        "pct_io_deviation", F.when(F.col("avg_io") == 0, F.lit(0).cast("long")).otherwise(
            int_div(io_dev * 100, "avg_io")))
    s2 = top_n(s2, [F.col("pct_time_deviation").asc()] + _tiebreak(), n)
    s3 = s2.withColumn("impedance", F.col("pct_time_deviation") - F.col("pct_io_deviation"))
    s3 = s3.filter(F.abs("pct_time_deviation") - F.abs("pct_io_deviation") > impedance)
    s3 = top_n(s3, [F.col("impedance").asc()] + _tiebreak(), n)
    out = _decorate(s3, plans, texts, databases)
    return out.select("instance_id", *_HISTORY_COLS, "pct_io_deviation", "impedance", "sql_text", "parent_query",
                      "query_plan", "database_name")
