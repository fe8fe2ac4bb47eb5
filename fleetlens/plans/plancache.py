"""Cached-plan reports that look inside plan XML: missing indexes in plans
(R15), parallel plans (R35-R37) and plan features (R38-R41).

Plan documents can be large, so a cheap ``contains`` on the raw text runs
before any XML parse, and each document is parsed at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact_ratio, int_div, quote_name, statement_slice
from ..functions.text import contains_ci
from ..functions.xml import parse_xml, xml_scalar
from ..operators import conditional_split, database_scope, top_n
from .constants import (COMPILED_PLAN, CREATE_INDEX_PREFIX, FILLFACTOR_CLAUSE, INCLUDE_PREFIX, ONLINE_CLAUSE,
                        PLAN_FEATURES)


# the statement counters the reports show, each as total / last / min / max
STATEMENT_COUNTERS = [f"{k}_{c}" for c in ("worker_time", "physical_reads", "logical_writes", "logical_reads",
                                           "clr_time", "elapsed_time", "rows")
                      for k in ("total", "last", "min", "max")]


def _parallel_attrs(plan: Column) -> Column:
    """All ``RelOp/@Parallel`` values of a plan, in one XPath evaluation
    (operators nest to any depth, so a path query fits better than a schema)."""
    return F.call_function("xpath", plan, F.lit("//RelOp/@Parallel"))


def _is_parallel(v: Column) -> Column:
    # numeric flags ("1") as in the source; newer plans may write "true"
    return (F.lower(v) == "true") | (v.try_cast("double") > 0)


# a flag that is neither 0 nor false, and an operator's flag whatever its value: scans of the raw text, no parse
_FLAG_SET = r"""\bParallel\s*=\s*["'](?!\s*(?:0+|[Ff]alse)\s*["'])"""
_FLAG = r"""<(?:\w+:)?RelOp\s(?:[^>"']++|"[^"]*+"|'[^']*+')*?\bParallel\s*="""


# an operator whose flag is set, as _is_parallel tells it
_PARALLEL_OPERATOR = "//RelOp[@Parallel > 0 or translate(@Parallel, 'TRUE', 'true') = 'true']"


def has_parallel_operator(plan: Column) -> Column:
    """``max(//RelOp/@Parallel) > 0``: some operator of the plan runs in parallel.  Only plans
    with some flag set are parsed, for this one value (G18)."""
    return F.when(plan.rlike(_FLAG_SET), xml_scalar(plan, _PARALLEL_OPERATOR, "boolean")).otherwise(F.lit(False))


def parallel_flag(plan: Column) -> Column:
    """``max(//RelOp/@Parallel)`` as 1 / 0, NULL when there is no plan or it has no operator.  Only plans
    with some flag set, or with a flag on something else than an operator, are parsed (once)."""
    attrs = _parallel_attrs(plan)
    parsed = F.when(F.size(attrs) == 0, F.lit(None)).when(F.exists(attrs, _is_parallel), F.lit(1)).otherwise(F.lit(0))
    return F.when(plan.isNull() | ~plan.contains("Parallel"), F.lit(None)).when(~plan.rlike(_FLAG_SET) & plan.rlike(_FLAG), F.lit(0)).otherwise(parsed)


def _compiled(cached_plans: DataFrame) -> DataFrame:
    return cached_plans.filter(F.col("cacheobjtype") == COMPILED_PLAN)


def parallel_plan_statements(qs, cached_plans, plans, texts, objects, n: int = 50, per=None) -> DataFrame:
    """Per plan (max executions, summed counters), plans with a parallel
    operator, by average CPU per execution (integer division).

    The parallel test runs where the plans are read and keeps only the plan
    keys; the plan XML itself is joined back for the ``n`` ranked plans."""
    agg = qs.groupBy("instance_id", "plan_handle").agg(
        F.max("execution_count").alias("execution_count"),
        F.sum("total_worker_time").alias("total_worker_time"),
        F.sum("total_logical_reads").alias("total_logical_reads"),
        F.sum("total_elapsed_time").alias("total_elapsed_time"))
    cp = _compiled(cached_plans).select("instance_id", "plan_handle", "sql_handle")
    parallel = plans.filter(has_parallel_operator(F.col("query_plan"))).select(
        "instance_id", "plan_handle", "dbid", "objectid")
    j = agg.join(cp, ["instance_id", "plan_handle"]).join(parallel, ["instance_id", "plan_handle"])
    j = j.join(texts.select("instance_id", "sql_handle"), ["instance_id", "sql_handle"], "left_semi")
    j = j.withColumn("_avg", int_div("total_worker_time", "execution_count"))
    top = top_n(j, [F.col("_avg").desc(), F.col("instance_id"), F.col("plan_handle")], n, per)
    t = texts.select("instance_id", "sql_handle", "text")
    o = objects.select("instance_id", F.col("database_id").alias("dbid"), F.col("object_id").alias("objectid"),
                       F.col("name").alias("object_name"))
    xml = plans.select("instance_id", "plan_handle", "query_plan")
    out = top.join(t, ["instance_id", "sql_handle"]).join(xml, ["instance_id", "plan_handle"])
    out = out.join(o, ["instance_id", "dbid", "objectid"], "left")
    return out.select("instance_id", "object_name", "execution_count", "total_worker_time",
                      "total_logical_reads", "total_elapsed_time", "query_plan", "text", "plan_handle")


def parallel_ratio(qs, cached_plans, plans, texts) -> DataFrame:
    """CPU time and executions of parallel vs serial plans, shares and
    average degree of parallelism, per instance (G16)."""
    agg = qs.groupBy("instance_id", "plan_handle").agg(
        F.max("execution_count").alias("execution_count"),
        F.sum("execution_count").alias("execution_count_for_dop"),
        F.sum("total_worker_time").alias("total_worker_time"),
        F.sum("total_dop").alias("total_dop"))
    cp = _compiled(cached_plans).select("instance_id", "plan_handle", "sql_handle")
    p = plans.select("instance_id", "plan_handle", parallel_flag(F.col("query_plan")).alias("has_parallel"))
    j = agg.join(cp, ["instance_id", "plan_handle"]).join(p, ["instance_id", "plan_handle"])
    j = j.join(texts.select("instance_id", "sql_handle"), ["instance_id", "sql_handle"], "left_semi")
    # One aggregation splits every measure on "has a parallel operator";
    # plans without any operator (flag NULL) fall on neither side
    g = conditional_split(j, F.col("has_parallel") > 0,
                          ["total_worker_time", "execution_count", "total_dop", "execution_count_for_dop"],
                          keys=["instance_id"])
    g = g.select("instance_id",
                 F.col("total_total_worker_time").alias("total_worker_time"),
                 F.col("false_total_worker_time").alias("nonparallel_total_worker_time"),
                 F.col("true_total_worker_time").alias("parallel_total_worker_time"),
                 F.col("total_execution_count").alias("total_execution_count"),
                 F.col("false_execution_count").alias("nonparallel_execution_count"),
                 F.col("false_total_dop").alias("nonparallel_total_dop"),
                 F.col("true_execution_count").alias("parallel_execution_count"),
                 F.col("true_total_dop").alias("parallel_total_dop"),
                 F.col("false_execution_count_for_dop").alias("_ser_dop_n"),
                 F.col("true_execution_count_for_dop").alias("_par_dop_n"))

    def pct(a: str, b: str) -> Column:
        return exact_ratio(a, b, factor=100, scale=6, precision=38)

    return g.select(
        "instance_id", "total_worker_time", "nonparallel_total_worker_time", "parallel_total_worker_time",
        pct("nonparallel_total_worker_time", "total_worker_time").alias("nonparallel_workertime_percentage"),
        pct("parallel_total_worker_time", "total_worker_time").alias("parallel_workertime_percentage"),
        "total_execution_count", "nonparallel_execution_count",
        F.col("nonparallel_total_dop").cast("decimal(38,4)").alias("nonparallel_total_dop"),
        "parallel_execution_count",
        F.col("parallel_total_dop").cast("decimal(38,4)").alias("parallel_total_dop"),
        pct("nonparallel_execution_count", "total_execution_count").alias("nonparallel_execution_count_percentage"),
        pct("parallel_execution_count", "total_execution_count").alias("parallel_execution_count_percentage"),
        exact_ratio("nonparallel_total_dop", "_ser_dop_n", scale=6, precision=38).alias("nonparallel_avg_dop"),
        exact_ratio("parallel_total_dop", "_par_dop_n", scale=6, precision=38).alias("parallel_avg_dop"))


def parallel_statements_with_text(qs, cached_plans, plans, texts, databases, text: str) -> DataFrame:
    """Statements of parallel compiled plans whose batch text contains
    ``text``, with average CPU per execution.

    Matching texts and parallel plans are reduced to their keys first; the
    batch text and plan XML are joined to the matching statements last."""
    cp = _compiled(cached_plans).select("instance_id", "plan_handle", F.col("sql_handle").alias("_cp_sql"))
    parallel = plans.filter(has_parallel_operator(F.col("query_plan"))).select("instance_id", "plan_handle", "dbid")
    hits = texts.filter(contains_ci("text", text)).select("instance_id", F.col("sql_handle").alias("_cp_sql"))
    j = cp.join(parallel, ["instance_id", "plan_handle"]).join(hits, ["instance_id", "_cp_sql"], "left_semi")
    j = j.join(qs, ["instance_id", "plan_handle"])
    d = databases.select("instance_id", F.col("database_id").alias("dbid"), F.col("name").alias("database_name"))
    j = j.join(d, ["instance_id", "dbid"], "left")
    t = texts.select("instance_id", F.col("sql_handle").alias("_cp_sql"), F.col("text").alias("parent_query"))
    j = j.join(t, ["instance_id", "_cp_sql"]).join(plans.select("instance_id", "plan_handle", "query_plan"),
                                                   ["instance_id", "plan_handle"])
    return j.select(
        "instance_id",
        statement_slice("parent_query", "statement_start_offset", "statement_end_offset").alias("sql_text"),
        "parent_query", "query_plan", "sql_handle", "statement_start_offset", "statement_end_offset",
        "execution_count", *STATEMENT_COUNTERS, "creation_time", "last_execution_time",
        int_div("total_worker_time", "execution_count").alias("avg_worker_time"), "plan_handle", "database_name")


def plans_with_feature(cached_plans, plans, texts, databases, marker: str, n: int = 20,
                       database_id=None, per=None) -> DataFrame:
    """Cached plans whose XML contains ``marker``, most used first.

    The marker test is a byte search on the raw plan text (XML element names
    are case-exact), so no plan is parsed."""
    p = plans.select("instance_id", "plan_handle", "dbid", "query_plan").filter(
        F.col("query_plan").contains(marker))
    p = database_scope(p, "dbid", database_id)
    cp = cached_plans.select("instance_id", "plan_handle", "sql_handle", "usecounts")
    j = cp.join(p.select("instance_id", "plan_handle", "dbid"), ["instance_id", "plan_handle"])
    j = j.join(texts.select("instance_id", "sql_handle"), ["instance_id", "sql_handle"], "left_semi")
    top = top_n(j, [F.col("usecounts").desc(), F.col("instance_id"), F.col("plan_handle")], n, per)
    t = texts.select("instance_id", "sql_handle", F.col("text").alias("parent_query"))
    d = databases.select("instance_id", F.col("database_id").alias("dbid"), F.col("name").alias("database_name"))
    out = top.join(t, ["instance_id", "sql_handle"]).join(
        p.select("instance_id", "plan_handle", "query_plan"), ["instance_id", "plan_handle"])
    out = out.join(d, ["instance_id", "dbid"], "left")
    return out.select("instance_id", "parent_query", "database_name", F.col("usecounts").alias("usage_count"),
                      "query_plan")


_COLS = "ARRAY<STRUCT<_Usage: STRING, Column: ARRAY<STRUCT<_Name: STRING>>>>"
PLAN_SCHEMA = (
    "BatchSequence STRUCT<Batch: ARRAY<STRUCT<Statements: ARRAY<STRUCT<StmtSimple: ARRAY<STRUCT<"
    "_StatementText: STRING, QueryPlan: STRUCT<_CachedPlanSize: INT, _CompileTime: INT, _CompileCPU: INT, "
    "_CompileMemory: INT, MissingIndexes: STRUCT<MissingIndexGroup: ARRAY<STRUCT<_Impact: DOUBLE, "
    f"MissingIndex: STRUCT<_Database: STRING, _Schema: STRING, _Table: STRING, ColumnGroup: {_COLS}>>>>>>>>>>>>")


def _column_list(groups: Column, usage: str) -> Column:
    """Distinct column names (brackets removed) of one usage, sorted; empty when none."""
    names = F.flatten(F.transform(F.filter(groups, lambda g: g["_Usage"] == usage),
                                  lambda g: F.transform(g["Column"], lambda c: F.replace(
                                      F.replace(c["_Name"], F.lit("]"), F.lit("")), F.lit("["), F.lit("")))))
    return F.coalesce(F.array_sort(F.array_distinct(names)), F.array().cast("array<string>"))


def missing_indexes_from_plans(qs, plans, engine_edition: int = 2) -> DataFrame:
    """One row per missing-index group of each cached statement: impact,
    target table, CREATE INDEX text and the statement's counters.

    Name parts that are missing are skipped (the source's ``+`` would make
    the whole text NULL)."""
    p = plans.select("instance_id", "plan_handle", "query_plan").filter(
        F.col("query_plan").contains("<MissingIndexGroup"))
    doc = parse_xml(F.col("query_plan"), PLAN_SCHEMA)
    stmts = F.flatten(F.transform(doc["BatchSequence"]["Batch"],
                                  lambda b: F.flatten(F.transform(b["Statements"], lambda s: s["StmtSimple"]))))
    # the exploded rows carry parsed fields only; the plan XML is joined back once at the end
    p = p.select("instance_id", "plan_handle", F.explode(stmts).alias("st"))
    p = p.select("*", F.explode(F.col("st.QueryPlan.MissingIndexes.MissingIndexGroup")).alias("grp"))
    mi = F.col("grp.MissingIndex")
    eq, ineq, inc = (_column_list(mi["ColumnGroup"], u) for u in ("EQUALITY", "INEQUALITY", "INCLUDE"))
    p = p.select("instance_id", "plan_handle",
                 F.col("st._StatementText").alias("sql_text"), F.col("grp._Impact").alias("impact"),
                 F.col("st.QueryPlan._CachedPlanSize").alias("cached_plan_size"),
                 F.col("st.QueryPlan._CompileTime").alias("compile_time"),
                 F.col("st.QueryPlan._CompileCPU").alias("compile_cpu"),
                 F.col("st.QueryPlan._CompileMemory").alias("compile_memory"),
                 F.concat(mi["_Database"], F.lit("."), mi["_Schema"], F.lit("."), mi["_Table"]).alias("object"),
                 eq.alias("_eq"), ineq.alias("_ineq"), inc.alias("_inc"))
    e, i, c = F.col("_eq"), F.col("_ineq"), F.col("_inc")
    # a column's own commas become underscores in the index name, like the ones between columns
    name = F.concat(F.lit("IX_"), F.replace(F.array_join(F.concat(e, i, c), "_"), F.lit(","), F.lit("_")))
    keys = F.concat(e, i)
    key_cols = F.when(F.size(keys) > 0, F.array_join(keys, ","))
    create = F.concat(
        F.lit(CREATE_INDEX_PREFIX), quote_name(name), F.lit(" ON "), F.col("object"),
        F.coalesce(F.concat(F.lit("("), key_cols, F.lit(")")), F.lit("")),
        F.when(F.size(c) > 0, F.concat(F.lit(INCLUDE_PREFIX), F.array_join(c, ","), F.lit(")"))).otherwise(F.lit("")),
        F.lit(FILLFACTOR_CLAUSE + (ONLINE_CLAUSE if engine_edition == 3 else "") + ");"))
    p = p.withColumn("miss_index_creation", create).drop("_eq", "_ineq", "_inc")
    q = qs.select("instance_id", "plan_handle", "query_hash", "query_plan_hash", "creation_time",
                  "last_execution_time", "execution_count", *STATEMENT_COUNTERS)
    out = q.join(p, ["instance_id", "plan_handle"])
    return out.join(plans.select("instance_id", "plan_handle", "query_plan"), ["instance_id", "plan_handle"])
