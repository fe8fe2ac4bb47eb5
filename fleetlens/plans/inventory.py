"""Modules, dependencies, columns (R44-R48), IO and space (R51-R57) and
server / database inventory (R60-R64)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact_ratio, int_div, rewrite_text, safe_ratio
from ..functions.text import contains_ci
from ..operators import distinct_pairs, latest_per_key, multi_filter, sample_keys, unused_keys
from ..operators.joins import planned_bytes
from .constants import DB_COUNTER_OBJECT_PATTERN, DB_SIZE_COUNTERS, MODULE_REWRITES, MODULE_TYPES


# ---------------------------------------------------------------- modules and columns
DB = ["instance_id", "database_id"]   # catalog ids are unique inside one database only


#: Rows of a catalog table that one task reduces at a time, about, and what they take in files.
ROWS_PER_TASK = 500_000
BYTES_PER_TASK = 2_500_000
#: An estimate beyond this says that the planner doesn't know the size.
_UNKNOWN = 1 << 50


def _tasks_for(rows: DataFrame) -> int | None:
    """How many tasks a table is dealt out to, by its size in files (a table that isn't read from files is counted); None for one."""
    size = planned_bytes(rows)
    parts = (size // BYTES_PER_TASK if size < _UNKNOWN else rows.count() // ROWS_PER_TASK) + 1
    return parts if parts > 1 else None


def table_references(depends: DataFrame, sysobjects: DataFrame, proc: str = "") -> DataFrame:
    """Distinct (procedure, table) dependencies of procedures whose name contains ``proc``.

    The pairs of ids are reduced before any name is joined.  They are nearly all different, so a set of them is as large as
    its task's share of the rows: the tasks grow in number with the table, not in size."""
    parts = _tasks_for(depends)
    o = sysobjects.filter(F.col("xtype") == "P").select(*DB, "id", F.col("name").alias("proc_name"))
    if proc:
        o = o.filter(contains_ci("proc_name", proc))
    oo = sysobjects.select(*DB, F.col("id").alias("depid"), F.col("name").alias("table_name"))
    pairs = distinct_pairs(depends, [*DB, "id", "depid"], parts)
    j = pairs.join(o, [*DB, "id"]).join(oo, [*DB, "depid"])
    return distinct_pairs(j, [*DB, "proc_name", "table_name"], parts)


def modules_mentioning(module_objects: DataFrame, sql_modules: DataFrame, name: str) -> DataFrame:
    """Modules whose source text contains ``name``, one row per object (the text is no key)."""
    o = module_objects.select(*DB, "object_id", "name", F.col("type").alias("xtype")).dropDuplicates([*DB, "object_id"])
    m = sql_modules.filter(contains_ci("definition", name))
    return m.join(o, [*DB, "object_id"]).select(*DB, "name", "xtype", F.col("definition").alias("text"))


def unused_procedures(procedures: DataFrame, procedure_stats: DataFrame) -> DataFrame:
    """Procedures with no execution statistics in their database (left anti join)."""
    return unused_keys(procedures, procedure_stats, [*DB, "object_id"]).select(*DB, "name", "type_desc")


def column_type_conflicts(columns: DataFrame) -> DataFrame:
    """Columns whose name appears elsewhere with a different type,
    length, precision or scale, with the name's prevalence %.

    No self join: per (database, name) the smallest and largest non-NULL
    value of each attribute are taken (plain partial aggregates, no
    distinct-count expansion); a row conflicts when, for some attribute, its
    own value is not NULL and the name has two different non-NULL values,
    i.e. ``min < max`` (the same rows the source's ``c1.x != c2.x`` self join
    keeps).  Prevalence is
    the source's ``COUNT(name) * 100 / COUNT(*) OVER ()`` after grouping by
    name, i.e. divided by the number of distinct names, integer division."""
    attrs = ["data_type", "character_maximum_length", "numeric_precision", "numeric_scale"]
    key = [*DB, "column_name"]
    per_name = columns.groupBy(*key).agg(F.count("column_name").alias("_n"),
                                         *[x for a in attrs for x in (F.min(a).alias(f"_lo_{a}"),
                                                                      F.max(a).alias(f"_hi_{a}"))])
    names = per_name.groupBy(*DB).agg(F.count("*").alias("_groups"))
    per_name = per_name.join(names, DB).withColumn(
        "pct", int_div(F.col("_n") * 100, "_groups").cast("decimal(12,2)"))
    j = columns.join(per_name, key)
    cond = None
    for a in attrs:
        c = F.col(a).isNotNull() & (F.col(f"_lo_{a}") < F.col(f"_hi_{a}"))
        cond = c if cond is None else cond | c
    return j.filter(cond).select(*DB, "column_name", "table_schema", "table_name", *attrs, "pct").distinct()




def rewrite_modules(module_objects: DataFrame, sql_modules: DataFrame, replacements=MODULE_REWRITES) -> DataFrame:
    """New source text of views, functions and procedures after ordered
    literal replacements (G23).  Executing the text is not part of the engine."""
    o = module_objects.filter(F.col("type").isin(list(MODULE_TYPES)))
    j = o.join(sql_modules, [*DB, "object_id"])
    return j.select(*DB, "name", rewrite_text("definition", replacements).alias("sentence"))


# ---------------------------------------------------------------- IO and space
def disk_latency(file_stats: DataFrame, master_files: DataFrame) -> DataFrame:
    """Per drive letter: read, write and overall latency and bytes per
    transfer (integer division; a zero divisor gives 0)."""
    j = file_stats.join(master_files.select("instance_id", "database_id", "file_id", "physical_name"),
                        ["instance_id", "database_id", "file_id"])
    g = j.groupBy("instance_id", F.left(F.upper("physical_name"), F.lit(2)).alias("disk_drive")).agg(
        *[F.sum(c).alias(c) for c in ("num_of_reads", "io_stall_read_ms", "num_of_writes", "io_stall_write_ms",
                                      "num_of_bytes_read", "num_of_bytes_written", "io_stall")])
    r, w = F.col("num_of_reads"), F.col("num_of_writes")

    def per(num, den, name: str):
        return safe_ratio(num, den, 0, whole=True).alias(name)

    return g.select(
        "instance_id", "disk_drive", per("io_stall_read_ms", r, "read_latency"), per("io_stall_write_ms", w, "write_latency"),
        per("io_stall", r + w, "overall_latency"), per("num_of_bytes_read", r, "avg_bytes_per_read"),
        per("num_of_bytes_written", w, "avg_bytes_per_write"),
        per(F.col("num_of_bytes_read") + F.col("num_of_bytes_written"), r + w, "avg_bytes_per_transfer"))


def file_io_mix(file_stats: DataFrame, database_files: DataFrame, databases: DataFrame) -> DataFrame:
    """Per file: stall, count and byte shares (decimal(10,1), NULL for a
    zero total) and MB read / written."""
    f = database_files.select("instance_id", "database_id", "file_id", F.col("name").alias("logical_name"),
                              F.col("physical_name").alias("ph_name"))
    d = databases.select("instance_id", "database_id", F.col("name").alias("db_name"))
    j = file_stats.join(f, ["instance_id", "database_id", "file_id"]).join(d, ["instance_id", "database_id"], "left")
    sr, sw = F.col("io_stall_read_ms"), F.col("io_stall_write_ms")
    nr, nw = F.col("num_of_reads"), F.col("num_of_writes")
    br, bw = F.col("num_of_bytes_read"), F.col("num_of_bytes_written")

    def share(a, b):
        return exact_ratio(a, a + b, scale=1, factor=100, precision=10)

    return j.select(
        "instance_id", "db_name", "logical_name", "file_id", "ph_name", "num_of_reads", "num_of_writes",
        "io_stall_read_ms", "io_stall_write_ms", share(sr, sw).alias("io_stall_reads_pct"),
        share(sw, sr).alias("io_stall_writes_pct"), (nr + nw).alias("writes_plus_reads"),
        exact_ratio(br, F.lit(1048576), precision=10).alias("mb_read"),
        exact_ratio(bw, F.lit(1048576), precision=10).alias("mb_written"),
        share(nr, nw).alias("reads_pct"), share(nw, nr).alias("writes_pct"),
        share(br, bw).alias("read_bytes_pct"), share(bw, br).alias("written_bytes_pct"))


def table_sizes(objects, indexes, partitions, allocation_units) -> DataFrame:
    """Total and used MB per table name and row count (integer MB)."""
    t = objects.filter(~F.col("is_ms_shipped") & (F.col("type") == "U")).select(
        "instance_id", "database_id", "object_id", F.col("name").alias("table_name"))
    i = indexes.filter(F.col("object_id") > 255).select("instance_id", "database_id", "object_id", "index_id")
    p = partitions.select("instance_id", "database_id", "object_id", "index_id", "partition_id", "rows")
    a = allocation_units.select(*DB, F.col("container_id").alias("partition_id"), "total_pages", "used_pages")
    j = t.join(i, ["instance_id", "database_id", "object_id"]).join(
        p, ["instance_id", "database_id", "object_id", "index_id"]).join(a, [*DB, "partition_id"])
    g = j.groupBy("instance_id", "database_id", "table_name", "rows").agg(
        F.sum("total_pages").alias("_tp"), F.sum("used_pages").alias("_up"))
    return g.select("instance_id", "database_id", "table_name", F.col("rows").alias("row_count"),
                    int_div(F.col("_tp") * 8, 1024).alias("total_space_mb"),
                    int_div(F.col("_up") * 8, 1024).alias("used_space_mb"))


def file_free_space(database_files: DataFrame) -> DataFrame:
    """size/128 - used/128 MB per file."""
    return database_files.select("instance_id", "database_id", "name",
                                 exact_ratio(F.col("size") - F.col("space_used"), F.lit(128), scale=7,
                                             precision=38).alias("available_space_mb"))




def database_sizes(counters: DataFrame) -> DataFrame:
    """Data, log and used-log size in MB per database."""
    c = counters.filter(F.rtrim("object_name").like(DB_COUNTER_OBJECT_PATTERN) & F.col("counter_name").isin(list(DB_SIZE_COUNTERS)))
    return c.select("instance_id", "instance_name", "counter_name",
                    exact_ratio("cntr_value", F.lit(1024), scale=6, precision=38).alias("size_mb"))


_SPACE = ["user_object_reserved_page_count", "internal_object_reserved_page_count",
          "version_store_reserved_page_count", "mixed_extent_page_count", "unallocated_extent_page_count"]


def _mb(pages) -> F.Column:
    """pages * 8 / 1024 MB, exact (1/128 has 7 decimals)."""
    return exact_ratio(pages, F.lit(128), scale=7, precision=38)


def temp_space_total(space: DataFrame) -> DataFrame:
    """Total and used temp space MB per instance."""
    z = [F.coalesce(F.col(c), F.lit(0)) for c in _SPACE]
    keys = sample_keys(space)
    g = space.groupBy(*keys).agg(F.sum(z[0] + z[1] + z[2] + z[3] + z[4]).alias("_t"),
                                 F.sum(z[0] + z[1] + z[2] + z[3]).alias("_u"))
    return g.select(*keys, _mb("_t").alias("total_size_mb"), _mb("_u").alias("used_size_mb"))


def temp_space_by_kind(space: DataFrame) -> DataFrame:
    """The five kinds of temp space in MB per instance."""
    names = ["user_objects_mb", "internal_objects_mb", "version_store_mb", "mixed_extent_mb", "unallocated_mb"]
    keys = sample_keys(space)
    g = space.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in _SPACE])
    return g.select(*keys, *[_mb(c).alias(n) for c, n in zip(_SPACE, names)])


# ---------------------------------------------------------------- inventory
def latest_restore(databases: DataFrame, restores: DataFrame) -> DataFrame:
    """Newest restore per database; databases never restored keep one
    row with NULL restore columns.  Restores are reduced to one row per
    destination first (partial aggregation), then joined to the databases."""
    last = latest_per_key(restores, ["instance_id", "destination_database_name"],
                          ["restore_date", "restore_history_id"], ["restore_type"])
    d = databases.select("instance_id", F.col("name").alias("database_name"), "create_date",
                         "compatibility_level", "collation_name")
    j = d.join(last, (d["instance_id"] == last["instance_id"])
               & (d["database_name"] == last["destination_database_name"]), "left").drop(last["instance_id"])
    return j.select("instance_id", "database_name", "create_date", "compatibility_level", "collation_name",
                    "restore_history_id", "restore_date", "destination_database_name", "restore_type")


def database_inventory(databases: DataFrame) -> DataFrame:
    """Name, id and creation date of every database."""
    return databases.select("instance_id", "name", "database_id", "create_date")


def table_inventory(objects, schemas, databases, server=None, database=None, schema=None, table=None) -> DataFrame:
    """Every user table of the fleet, with optional substring filters."""
    t = objects.filter(F.col("type") == "U").select("instance_id", "database_id", "schema_id",
                                                    F.col("name").alias("table_name"))
    s = schemas.select("instance_id", "database_id", "schema_id", F.col("name").alias("schema_name"))
    d = databases.select("instance_id", "database_id", F.col("name").alias("db_name"))
    j = t.join(s, ["instance_id", "database_id", "schema_id"]).join(d, ["instance_id", "database_id"])
    j = j.select(F.col("instance_id").alias("server_name"), "db_name", "schema_name", "table_name")
    return multi_filter(j, {"server_name": server, "db_name": database, "schema_name": schema,
                            "table_name": table})


def statistics_options(databases: DataFrame) -> DataFrame:
    """Automatic statistics flags per database."""
    return databases.select("instance_id", F.col("name").alias("database_name"),
                            F.col("is_auto_create_stats_on").alias("auto_create_statistics"),
                            F.col("is_auto_update_stats_on").alias("auto_update_statistics"),
                            F.col("is_auto_update_stats_async_on").alias("auto_update_statistics_async"))


def last_restart(system_info: DataFrame) -> DataFrame:
    """Newest start time per instance (the counter-reset boundary for deltas)."""
    return system_info.groupBy("instance_id").agg(F.max("server_start_time").alias("server_start_time"))
