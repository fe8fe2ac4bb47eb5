"""Index usage and health reports.

Catalog rows (objects, schemas, indexes) are small per instance but a fleet
holds many instances, so they are joined with plain equi joins on the full
key ``(instance_id, database_id, object_id[, index_id])`` and the planner
decides between broadcast (below the size threshold) and shuffle joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact_ratio
from ..operators import top_n, unused_keys, with_index_names

DB = ["instance_id", "database_id"]
OBJ = DB + ["object_id"]
IDX = OBJ + ["index_id"]
NAME_ORDER = ["instance_id", "database_id", "object_id", "index_id"]


def _names(fact, indexes, objects, schemas, **kw) -> DataFrame:
    """G02 name resolution (see ``operators.with_index_names``)."""
    return with_index_names(fact, indexes, objects, schemas, **kw)


def _key_order() -> list[Column]:
    return [F.col(c).asc() for c in NAME_ORDER]


def _reads(prefix: str = "user") -> Column:
    return F.col(f"{prefix}_seeks") + F.col(f"{prefix}_scans") + F.col(f"{prefix}_lookups")


def most_used_indexes(usage, indexes, objects, schemas, n: int = 20, per=None) -> DataFrame:
    """reads = seeks + scans + lookups, most read first."""
    u = _names(usage.withColumn("usage", _reads()), indexes, objects, schemas, index_cols=["fill_factor"])
    top = top_n(u, [F.col("usage").desc()] + _key_order(), n, per)
    return top.select(*DB, "schema_name", "table_name", "index_name", "usage", "user_updates", "fill_factor")


def high_maintenance_indexes(usage, indexes, objects, schemas, n: int = 20, per=None) -> DataFrame:
    """Maintenance cost = updates - reads, with system usage and last use times."""
    u = usage.withColumn("retrieval_usage", _reads()).withColumn(
        "maintenance_cost", F.col("user_updates") - F.col("retrieval_usage"))
    u = _names(u.filter(F.col("retrieval_usage") >= 0), indexes, objects, schemas)
    top = top_n(u, [F.col("maintenance_cost").desc()] + _key_order(), n, per)
    return top.select(*DB, "schema_name", "table_name", "index_name", F.col("user_updates").alias("update_usage"),
                      "retrieval_usage", "maintenance_cost", _reads("system").alias("system_usage"),
                      "last_user_seek", "last_user_scan", "last_user_lookup")


def costly_unused_indexes(usage, indexes, objects, schemas, n: int = 20, per=None) -> DataFrame:
    """Indexes with no user seek, scan or lookup, most updated first."""
    u = usage.filter((F.col("user_seeks") == 0) & (F.col("user_scans") == 0) & (F.col("user_lookups") == 0))
    u = _names(u, indexes, objects, schemas)
    top = top_n(u, [F.col("user_updates").desc()] + _key_order(), n, per)
    return top.select(*DB, "schema_name", "table_name", "index_name", "user_updates",
                      _reads("system").alias("system_usage"))


def unused_indexes(usage, indexes, objects, schemas) -> DataFrame:
    """Named user indexes with no usage row in their database (left anti join)."""
    i = indexes.select(*IDX, "name").filter(F.col("name").isNotNull())
    unused = unused_keys(i, usage, IDX)
    named = _names(unused.drop("name"), indexes, objects, schemas)
    return named.select(*DB, "schema_name", "table_name", "index_name")


def largest_unused_indexes(usage, indexes, objects, schemas, partition_stats,
                           include_user_reads: bool = False) -> DataFrame:
    """Size (used pages * 8 KB, > 0) of indexes with no system usage.

    The source tests only the system counters; ``include_user_reads=True``
    also requires no user seek, scan or lookup."""
    size = partition_stats.groupBy(*IDX).agg((F.sum("used_page_count") * 8).alias("index_size_kb")) \
        .filter(F.col("index_size_kb") > 0)
    u = usage.select(*IDX, "user_updates", "system_seeks", "system_scans", "system_lookups",
                     "user_seeks", "user_scans", "user_lookups")
    j = _names(size, indexes, objects, schemas).join(u, IDX, "left")

    def zero_sum(prefix: str) -> F.Column:
        return (F.coalesce(F.col(f"{prefix}_seeks"), F.lit(0)) + F.coalesce(F.col(f"{prefix}_scans"), F.lit(0))
                + F.coalesce(F.col(f"{prefix}_lookups"), F.lit(0)))

    sys_usage = zero_sum("system")
    j = j.filter(sys_usage == 0)
    if include_user_reads:
        j = j.filter(zero_sum("user") == 0)
    return j.select(*DB, "schema_name", "table_name", "index_name",
                    F.coalesce(F.col("user_updates"), F.lit(0)).alias("user_updates"),
                    sys_usage.alias("system_usage"), "index_size_kb")


def fragmented_indexes(physical, indexes, objects, schemas, n: int = 100, min_frag: float = 5,
                       min_pages: int = 1000, per=None) -> DataFrame:
    """Fragmentation (rounded to 2) above ``min_frag`` on indexes over ``min_pages``."""
    p = physical.withColumn("fragmentation_pct", F.round("avg_fragmentation_in_percent", 2))
    p = p.filter((F.col("page_count") > min_pages) & (F.col("fragmentation_pct") > min_frag))
    p = _names(p, indexes, objects, schemas)
    top = top_n(p, [F.col("fragmentation_pct").desc()] + _key_order(), n, per)
    return top.select(*DB, "schema_name", "table_name", "index_name", "fragmentation_pct", "page_count")


def fragmentation_with_usage(usage, physical, indexes, objects, schemas) -> DataFrame:
    """Fragmentation and page count beside reads and updates of each used index."""
    u = _names(usage, indexes, objects, schemas, index_cols=["fill_factor"])
    u = u.join(physical.select(*IDX, "avg_fragmentation_in_percent", "page_count"), IDX)
    reads = _reads()
    return u.select(*DB, "schema_name", "table_name", F.col("object_id").alias("table_id"), "index_name",
                    F.col("index_id"), reads.alias("current_read_usage"),
                    F.col("user_updates").alias("current_update_usage"), reads.alias("diff_read_usage"),
                    F.col("user_updates").alias("diff_update_usage"), "fill_factor",
                    reads.cast("long").alias("diff_read_accumulated"),
                    F.col("user_updates").cast("long").alias("diff_update_accumulated"),
                    F.col("avg_fragmentation_in_percent").alias("fragmentation_percent"), "page_count")


# --- operational-stats contention family (R08-R13): one parametrised function
CONTENTION = {
    "row_lock_pressure": (lambda: F.col("row_lock_wait_in_ms"), "row_lock_wait_in_ms",
                          ["row_lock_wait_in_ms", "row_lock_wait_count"]),
    "page_latch_contention": (lambda: F.col("page_latch_wait_in_ms"), "page_latch_wait_in_ms",
                              ["page_latch_wait_in_ms", "page_latch_wait_count"]),
    "page_io_latch_contention": (lambda: F.col("page_io_latch_wait_in_ms"), "page_io_latch_wait_in_ms",
                                 ["page_io_latch_wait_in_ms", "page_io_latch_wait_count"]),
    "lock_escalations": (lambda: F.col("index_lock_promotion_count"), "index_lock_promotion_count",
                         ["index_lock_promotion_count"]),
    "failed_lock_promotions": (lambda: F.col("index_lock_promotion_attempt_count") - F.col("index_lock_promotion_count"),
                               "index_lock_promotion_count", ["unsuccessful_lock_promotions"]),
    "page_splits": (lambda: F.col("leaf_allocation_count"), "leaf_allocation_count",
                    ["leaf_allocation_count", "nonleaf_allocation_count"]),
}


def index_contention(opstats, indexes, objects, schemas, kind: str, n: int = 20, by: str | None = None,
                     per=None) -> DataFrame:
    """Indexes with the metric of ``kind`` > 0, top ``n``.

    ``failed_lock_promotions`` shows attempts - promotions but ranks by
    promotions, as the source does (``by=`` changes the ranking column)."""
    metric_of, order_col, cols = CONTENTION[kind]
    metric = metric_of()
    s = opstats.withColumn("unsuccessful_lock_promotions",
                           F.col("index_lock_promotion_attempt_count") - F.col("index_lock_promotion_count"))
    s = s.filter(metric > 0)
    s = _names(s, indexes, objects, schemas, named_only=False)
    top = top_n(s, [F.col(by or order_col).desc()] + _key_order(), n, per)
    return top.select(*DB, "schema_name", "table_name", "index_name", *cols)


def missing_indexes(groups, stats, details, n: int = 20, database_id=None, per=None) -> DataFrame:
    """cost = round(avg cost * impact * (seeks + scans), 0) over the three
    missing-index views, most costly first."""
    j = groups.join(stats.withColumnRenamed("index_handle", "_ih"), ["instance_id", "index_group_handle"])
    j = j.join(details, ["instance_id", "index_handle"])
    if database_id is not None:
        j = j.filter(F.col("database_id") == database_id)
    j = j.withColumn("total_cost", F.round(F.col("avg_total_user_cost") * F.col("avg_user_impact")
                                           * (F.col("user_seeks") + F.col("user_scans")), 0))
    top = top_n(j, [F.col("total_cost").desc(), F.col("instance_id"), F.col("index_group_handle"),
                    F.col("index_handle")], n, per)
    return top.select("instance_id", "total_cost", F.col("statement").alias("table_name"), "equality_columns",
                      "inequality_columns", "included_columns")


def fill_factor_inventory(indexes, objects, schemas) -> DataFrame:
    """Fill factor of named indexes of user tables."""
    i = indexes.select(*IDX, F.col("type_desc").alias("index_type"), "fill_factor")
    j = _names(i, indexes, objects, schemas, user_only=False, user_tables_only=True)
    return j.select(*DB, "schema_name", "table_name", F.col("object_type_desc").alias("type_desc"),
                    "index_name", "index_type", "fill_factor")


def statistics_staleness(row_counts, objects, schemas, min_rows: int = 500) -> DataFrame:
    """Rows, changes and changed % (decimal(28,2)) per index statistics."""
    r = row_counts.filter((F.col("object_id") > 100) & (F.col("index_id") > 0) & (F.col("rowcnt") >= min_rows))
    o = objects.filter(F.col("type") == "U").select(*OBJ, "schema_id", F.col("name").alias("table_name"))
    s = schemas.select(*DB, "schema_id", F.col("name").alias("schema_name"))
    j = r.join(o, OBJ).join(s, DB + ["schema_id"])
    return j.select(*DB, "schema_name", "table_name", F.col("name").alias("index_name"),
                    F.col("stats_date").alias("statistics_last_updated"), F.col("rowcnt").alias("row_count"),
                    F.col("rowmodctr").alias("number_of_changes"),
                    exact_ratio("rowmodctr", "rowcnt", factor=100).alias("pct_rows_changed"))


USAGE_COUNTERS = ["user_updates", "user_seeks", "user_scans", "user_lookups"]


def index_usage_between(pre_usage, post_usage, indexes, objects, schemas, pre_rows, post_rows) -> DataFrame:
    """Usage, row and modification deltas of indexes touched between two
    captures (any of the four usage counters changed).

    Each capture has its own usage and row counts; an index that was not in the first
    counts usage from 0 and has no row delta.  Captures pair on the index key (the source
    pairs on schema, table, index name and type, which name the same index), and
    the names are joined once, to the changed rows."""
    def capture(u: DataFrame, rows: DataFrame, prefix: str = "") -> DataFrame:
        c = u.select(*IDX, *USAGE_COUNTERS).join(rows.select(*IDX, "rowcnt", "rowmodctr"), IDX)
        return c.select(*IDX, *[F.col(x).alias(prefix + x) for x in USAGE_COUNTERS + ["rowcnt", "rowmodctr"]])

    j = capture(post_usage, post_rows).join(capture(pre_usage, pre_rows, "_p_"), IDX, "left")
    d = {c: F.col(c) - F.coalesce(F.col(f"_p_{c}"), F.lit(0)) for c in USAGE_COUNTERS}
    changed = d["user_updates"] != 0
    for c in USAGE_COUNTERS[1:]:
        changed = changed | (d[c] != 0)
    j = j.filter(changed).select(*IDX, *[d[c].alias(c) for c in USAGE_COUNTERS], (F.col("rowcnt") - F.col("_p_rowcnt")).alias("rows_inserted"),
                                 (F.col("rowmodctr") - F.col("_p_rowmodctr")).alias("updates_iud"))
    j = _names(j, indexes, objects, schemas, index_cols=[F.col("type_desc").alias("index_type"), "fill_factor"])
    return j.select(*DB, "schema_name", "table_name", "index_name", "index_type", *USAGE_COUNTERS, "rows_inserted", "updates_iud", "fill_factor")


ROW_ACTIVITY = ["leaf_delete_count", "leaf_ghost_count", "leaf_insert_count", "leaf_update_count",
                "range_scan_count", "singleton_lookup_count"]


def index_row_activity(pre_ops, post_ops, indexes, objects, schemas) -> DataFrame:
    """Leaf delete / ghost / insert / update, range scan and singleton
    lookup deltas per index; rows where any delta is positive."""
    from ..operators import snapshot_delta
    return _row_activity(snapshot_delta(pre_ops, post_ops, IDX, ROW_ACTIVITY, keep="positive", on_reset="raw"), indexes, objects, schemas)


def index_row_activity_between(captures, start, end, restarts, indexes, objects, schemas) -> DataFrame:
    """R76 over a table of captures, cut at the servers' starts."""
    from ..operators import segmented_delta
    return _row_activity(segmented_delta(captures, IDX, ROW_ACTIVITY, start, end, restarts, keep="positive"), indexes, objects, schemas)


def _row_activity(d, indexes, objects, schemas) -> DataFrame:
    d = _names(d, indexes, objects, schemas, named_only=False)
    return d.select(*DB, "schema_name", "table_name", "index_name",
                    *[F.col(f"delta_{c}").alias(f"{c}_delta") for c in ROW_ACTIVITY])


def row_lock_delta(pre_ops, post_ops, indexes, objects, schemas) -> DataFrame:
    """Row-lock wait growth between two captures of indexes under row-lock pressure."""
    from ..operators import snapshot_delta
    pre = pre_ops.filter(F.col("row_lock_wait_in_ms") > 0)
    post = post_ops.filter(F.col("row_lock_wait_in_ms") > 0)
    d = snapshot_delta(pre, post, IDX, ["row_lock_wait_in_ms"], keep="positive", on_reset="raw")
    d = _names(d, indexes, objects, schemas, named_only=False)
    return d.select(*DB, "schema_name", "table_name", "index_name",
                    F.col("delta_row_lock_wait_in_ms").alias("row_lock_wait_time_delta_ms"))
