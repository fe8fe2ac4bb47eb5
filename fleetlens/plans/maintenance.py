"""Usage ledger and maintenance plans (R20-R23) and duplicate / overlapping
indexes (R16).

The ledger is a versioned dataset: each run reads the last version, applies
one capture with ``upsert_ledger`` (G12) and writes a new version.  Running
the statements of a plan (ALTER INDEX, UPDATE STATISTICS) happens on the
servers, outside the engine.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quote_name
from ..functions.text import render_statement
from .constants import (ALTER_INDEX, DUPLICATE_INDEX_TYPES, REBUILD_SUFFIX, REORGANIZE_SUFFIX, STATS_REFRESH_PREFIX,
                        STATS_REFRESH_SUFFIX, SYSTEM_STATS_PREFIX)
from ..operators import ordered_string_agg, prefix_overlap, upsert_ledger

LEDGER_KEYS = ["instance_id", "database_id", "database_name", "schema_name", "table_name", "index_name"]
LEDGER_IDS = ["instance_id", "database_id", "table_id", "index_id"]
LEDGER_CARRY = ["table_id", "index_id", "fill_factor"]
LEDGER_COUNTERS = ["read_usage", "update_usage"]
LEDGER_NEVER = "1980-01-01 00:00:00"   # fixed value: the "no statement yet" date a new ledger row starts with


def ledger_capture(usage, indexes, objects, schemas, databases, captured: dt.datetime | None = None) -> DataFrame:
    """Named user-index usage, shaped for the ledger: one capture taken at ``captured``, or all the
    captures of a landed table (``captured_at``).  The catalog's names are joined with each other first, so the usage
    rows of all captures meet them in one join on the index's ids."""
    if captured is not None:
        usage = usage.withColumn("captured_at", F.lit(captured).cast("timestamp_ntz"))
    i = indexes.filter(F.col("name").isNotNull()).select(
        "instance_id", "database_id", "object_id", "index_id", F.col("name").alias("index_name"), "fill_factor")
    o = objects.filter(~F.col("is_ms_shipped")).select("instance_id", "database_id", "object_id", "schema_id",
                                                       F.col("name").alias("table_name"))
    s = schemas.select("instance_id", "database_id", "schema_id", F.col("name").alias("schema_name"))
    d = databases.select("instance_id", "database_id", F.col("name").alias("database_name"))
    names = i.join(o, ["instance_id", "database_id", "object_id"]).join(s, ["instance_id", "database_id", "schema_id"]).join(
        d, ["instance_id", "database_id"])
    j = usage.join(names, ["instance_id", "database_id", "object_id", "index_id"])
    return j.select(*LEDGER_KEYS, F.col("object_id").alias("table_id"), "index_id", "fill_factor",
                    (F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")).alias("read_usage"),
                    F.col("user_updates").alias("update_usage"),
                    "captured_at")


def ledger_bookkeeping() -> dict:
    """Columns a new ledger row starts with: no statement run yet."""
    return {"last_sentence": F.lit(""),
            "last_sentence_date": F.lit(LEDGER_NEVER).cast("timestamp_ntz"),
            "sentence_counter": F.lit(0).cast("long")}


def index_usage_ledger(ledger: DataFrame | None, capture: DataFrame) -> DataFrame:
    """The ledger after one more capture (``ledger=None`` seeds it)."""
    return upsert_ledger(ledger, capture, LEDGER_KEYS, LEDGER_COUNTERS, LEDGER_CARRY, keep=ledger_bookkeeping())


def acknowledge_maintenance(ledger: DataFrame, executed: DataFrame) -> DataFrame:
    """Record statements that were run: for each executed index
    (``executed``: ledger keys plus ``sentence`` and ``end_date``) the
    accumulated usage restarts from 0, the run count goes up and the last
    statement and its time are kept.  Other rows are unchanged.  One left
    join on the index key (executed rows are unique per index)."""
    e = executed.select(*LEDGER_KEYS, F.col("sentence").alias("_sentence"), F.col("end_date").alias("_at"),
                        F.lit(True).alias("_ran"))
    return _acknowledged(ledger.join(e, LEDGER_KEYS, "left"), ledger.columns, F.col("_ran").isNotNull(), F.col("_sentence"), F.col("_at"))


def _acknowledged(rows: DataFrame, columns: list[str], ran: Column, sentence: Column, at: Column) -> DataFrame:
    """The ledger's ``columns`` after a ``sentence`` ended at ``at`` where ``ran``."""
    updates = {
        "accumulated_read_usage": F.when(ran, F.lit(0).cast("long")).otherwise(F.col("accumulated_read_usage")),
        "accumulated_update_usage": F.when(ran, F.lit(0).cast("long")).otherwise(F.col("accumulated_update_usage")),
        "sentence_counter": F.when(ran, F.col("sentence_counter") + 1).otherwise(F.col("sentence_counter")),
        "last_sentence": F.when(ran, sentence).otherwise(F.col("last_sentence")),
        "last_sentence_date": F.when(ran, at).otherwise(F.col("last_sentence_date")),
    }
    return rows.select(*[updates.get(c, F.col(c)).alias(c) for c in columns])


def record_maintenance_runs(plan: DataFrame, executed: DataFrame) -> DataFrame:
    """Start, end and duration (whole seconds crossed, as DATEDIFF(s) counts)
    of each executed statement of a plan; statistics rows (no index) match
    on a NULL index name."""
    keys = ["instance_id", "database_name", "schema_name", "table_name"]
    e = executed.select(*[F.col(k).alias(f"_e_{k}") for k in keys + ["index_name"]], "start_date", "end_date")
    cond = None
    for k in keys + ["index_name"]:
        c = F.col(k).eqNullSafe(F.col(f"_e_{k}"))
        cond = c if cond is None else cond & c
    j = plan.join(e, cond, "left")
    secs = (F.unix_timestamp(F.date_trunc("second", F.col("end_date")).cast("timestamp"))
            - F.unix_timestamp(F.date_trunc("second", F.col("start_date")).cast("timestamp")))
    return j.select(*plan.columns, "start_date", "end_date", secs.cast("int").alias("duration"))


def _fragmented(physical: DataFrame, indexes: DataFrame, reorganize: float, min_pages: int, with_pks: bool) -> DataFrame:
    """Named indexes over ``min_pages`` pages and ``reorganize`` % fragmentation, by the ledger's ids: what no
    statement can be due for is gone before it meets the ledger."""
    i = indexes.filter(F.col("name").isNotNull())
    if not with_pks:
        i = i.filter(~F.col("is_primary_key"))
    i = i.select("instance_id", "database_id", F.col("object_id").alias("table_id"), "index_id", F.col("name").alias("_iname"))
    p = physical.select("instance_id", "database_id", F.col("object_id").alias("table_id"), "index_id", "page_count",
                        F.round("avg_fragmentation_in_percent", 2).alias("fragmentation_pct"),
                        F.round("avg_page_space_used_in_percent", 2).alias("page_density_pct"))
    return p.filter((F.col("page_count") > min_pages) & (F.col("fragmentation_pct") > reorganize)).join(i, LEDGER_IDS)


def _due(update_threshold: int) -> Column:
    """Ledger rows that were updated since the last run."""
    return (F.col("accumulated_update_usage") > update_threshold) & (F.col("diff_update_usage") > 0)


def _index_sentence(rebuild: float) -> Column:
    target = [quote_name("_iname"), " ON ", quote_name("database_name"), ".", quote_name("schema_name"), ".",
              quote_name("table_name")]
    return (F.when(F.col("fragmentation_pct") > rebuild, render_statement(ALTER_INDEX, *target, REBUILD_SUFFIX))
            .otherwise(render_statement(ALTER_INDEX, *target, REORGANIZE_SUFFIX)))


def index_maintenance_plan(ledger, physical, indexes, reorganize: float = 5, rebuild: float = 30,
                           min_pages: int = 1000, with_pks: bool = False, update_threshold: int = 0) -> DataFrame:
    """REBUILD above ``rebuild`` %, REORGANIZE above ``reorganize`` %
    fragmentation, for indexes over ``min_pages`` pages that were updated
    since the last run; ranked by pages."""
    j = ledger.filter(_due(update_threshold)).join(_fragmented(physical, indexes, reorganize, min_pages, with_pks), LEDGER_IDS)
    return j.select("instance_id", "database_name", "schema_name", "table_name", "index_name", "fragmentation_pct", "page_density_pct",
                    "page_count", F.lit(-1).cast("long").alias("modification_counter"), _index_sentence(rebuild).alias("sentence"),
                    F.col("page_count").alias("rank"))


def run_index_maintenance(ledger, physical, indexes, end_date: Column, only: Column | None = None, reorganize: float = 5,
                          rebuild: float = 30, min_pages: int = 1000, with_pks: bool = False, update_threshold: int = 0) -> DataFrame:
    """The ledger after the statements of its own plan (:func:`index_maintenance_plan`) were run and acknowledged
    (:func:`acknowledge_maintenance`), in one pass: the ledger, however it was made, stands in the plan once, and its rows
    are joined with the fragmented indexes only.  ``end_date`` (a Column on the ledger's rows) is when a statement
    ended, ``only`` a condition on them that says which were run (all where it is left out; NULL: not run).  An index with
    several physical rows counts once, with its most fragmented one, so no ledger row is doubled."""
    worst = _fragmented(physical, indexes, reorganize, min_pages, with_pks).groupBy(*LEDGER_IDS).agg(
        F.max("fragmentation_pct").alias("fragmentation_pct"), F.max("_iname").alias("_iname"))
    ran = F.col("fragmentation_pct").isNotNull() & _due(update_threshold)
    if only is not None:
        ran = ran & only
    return _acknowledged(ledger.join(worst, LEDGER_IDS, "left"), ledger.columns, ran, _index_sentence(rebuild), end_date)


def statistics_refresh_plan(objects, schemas, stats_properties, databases) -> DataFrame:
    """Per user table, the largest statistics modification counter and
    an UPDATE STATISTICS ... WITH FULLSCAN statement ranked by it."""
    o = objects.filter((F.col("type") == "U") & (F.col("object_id") > 100)).select(
        "instance_id", "database_id", "object_id", "schema_id", F.col("name").alias("table_name"))
    s = schemas.select("instance_id", "database_id", "schema_id", F.col("name").alias("schema_name"))
    d = databases.select("instance_id", "database_id", F.col("name").alias("database_name"))
    j = stats_properties.join(o, ["instance_id", "database_id", "object_id"]).join(
        s, ["instance_id", "database_id", "schema_id"]).join(d, ["instance_id", "database_id"])
    g = j.groupBy("instance_id", "database_id", "database_name", "schema_name", "table_name").agg(
        F.max("modification_counter").alias("modification_counter"))
    sentence = render_statement(STATS_REFRESH_PREFIX, F.col("database_name"), "].[", F.col("schema_name"), "].[",
                                F.col("table_name"), STATS_REFRESH_SUFFIX)
    return g.select("instance_id", "database_name", "schema_name", "table_name", F.lit(None).cast("string").alias("index_name"),
                    F.lit(-1).cast("double").alias("fragmentation_pct"), F.lit(-1).cast("double").alias("page_density_pct"),
                    F.lit(-1).cast("long").alias("page_count"), "modification_counter", sentence.alias("sentence"),
                    F.col("modification_counter").alias("rank"))


def maintenance_plan(ledger, physical, indexes, objects, schemas, stats_properties, databases, **kw) -> DataFrame:
    """The whole plan of the procedure: index statements, then statistics."""
    return index_maintenance_plan(ledger, physical, indexes, **kw).unionByName(
        statistics_refresh_plan(objects, schemas, stats_properties, databases))


def system_stats_refresh_list(indexes, partitions, objects, schemas) -> DataFrame:
    """One ``UPDATE STATISTICS [schema].[table];`` per index partition of
    system tables with rows.

    The source runs them as one string per database; here each is a row whose ``object_id, index_id,
    partition_id`` give its place, so no database's statements meet in one value or one task."""
    i = indexes.filter(F.col("index_id") > 0).select("instance_id", "database_id", "object_id", "index_id")
    p = partitions.filter(F.col("rows") > 0).select("instance_id", "database_id", "object_id", "index_id", "partition_id")
    o = objects.filter(F.col("is_ms_shipped")).select("instance_id", "database_id", "object_id", "schema_id",
                                                      F.col("name").alias("table_name"))
    s = schemas.select("instance_id", "database_id", "schema_id", F.col("name").alias("schema_name"))
    j = i.join(p, ["instance_id", "database_id", "object_id", "index_id"]).join(
        o, ["instance_id", "database_id", "object_id"]).join(s, ["instance_id", "database_id", "schema_id"])
    return j.select("instance_id", "database_id", "object_id", "index_id", "partition_id", render_statement(
        SYSTEM_STATS_PREFIX, quote_name("schema_name"), ".", quote_name("table_name"), ";").alias("sql"))


def duplicate_or_overlapping_indexes(tables, indexes, index_columns) -> DataFrame:
    """Key and include column lists per index, and the indexes whose key
    list equals, or is a prefix of, another index's key list on the same
    table (either direction).  See ``prefix_overlap`` for the linear-time
    method (no pairs of indexes are formed)."""
    ix = indexes.filter(F.col("type_desc").isin(*DUPLICATE_INDEX_TYPES))
    t = tables.filter(~F.col("is_ms_shipped")).select("instance_id", "database_id", "object_id", "schema_name",
                                                      "table_name")
    keys = ["instance_id", "database_id", "object_id", "index_id"]
    kc = index_columns.filter(~F.col("is_included_column")).withColumn(
        "_k", F.concat(F.col("column_name"), F.when(F.col("is_descending_key"), F.lit(" DESC")).otherwise(F.lit(" ASC"))))
    key_lists = kc.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("key_ordinal", "column_name", "_k"))),
                                                  lambda x: x["_k"]).alias("key_items"))
    inc = ordered_string_agg(index_columns.filter(F.col("is_included_column")), keys, "column_name",
                             ["key_ordinal", "column_name"], alias="include_column_list")
    j = ix.join(t, ["instance_id", "database_id", "object_id"]).join(key_lists, keys, "left").join(inc, keys, "left")
    j = j.withColumn("key_column_list", F.array_join("key_items", ", "))
    hits = prefix_overlap(j, ["instance_id", "database_id", "schema_name", "table_name"], "key_items", "index_name")
    return hits.select("instance_id", "database_id", "schema_name", "table_name", "index_name", "key_column_list",
                       "include_column_list", "is_disabled")
