"""Schemas of the telemetry tables (Spark DDL), checked at load.

A landed table must hold at least these columns with compatible types;
extra columns are allowed.  ``timestamp`` and ``timestamp_ntz`` are treated
as compatible, and integral columns may be wider than listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TELEMETRY_SCHEMAS: dict[str, str] = {
    "query_stats": "instance_id string, captured_at timestamp_ntz, sql_handle string, plan_handle string, query_hash string, query_plan_hash string, statement_start_offset int, statement_end_offset int, execution_count bigint, plan_generation_num bigint, total_worker_time bigint, total_elapsed_time bigint, last_worker_time bigint, last_elapsed_time bigint, total_logical_reads bigint, total_logical_writes bigint, total_physical_reads bigint, last_logical_reads bigint, last_logical_writes bigint, last_physical_reads bigint, total_clr_time bigint, last_clr_time bigint, min_clr_time bigint, max_clr_time bigint, min_worker_time bigint, max_worker_time bigint, min_elapsed_time bigint, max_elapsed_time bigint, min_physical_reads bigint, max_physical_reads bigint, min_logical_writes bigint, max_logical_writes bigint, min_logical_reads bigint, max_logical_reads bigint, total_rows bigint, last_rows bigint, min_rows bigint, max_rows bigint, total_dop bigint, creation_time timestamp_ntz, last_execution_time timestamp_ntz",
    "sql_texts": "instance_id string, sql_handle string, text string",
    "query_plans": "instance_id string, plan_handle string, dbid int, objectid int, query_plan string",
    "cached_plans": "instance_id string, plan_handle string, sql_handle string, cacheobjtype string, objtype string, usecounts bigint, attribute_dbid int",
    "databases": "instance_id string, database_id int, name string, create_date timestamp_ntz, is_auto_create_stats_on boolean, is_auto_update_stats_on boolean, is_auto_update_stats_async_on boolean, compatibility_level int, collation_name string",
    "wait_stats": "instance_id string, wait_type string, waiting_tasks_count bigint, wait_time_ms bigint, max_wait_time_ms bigint, signal_wait_time_ms bigint",
    "perf_counters": "instance_id string, captured_at timestamp_ntz, object_name string, counter_name string, instance_name string, cntr_value bigint, cntr_type int",
    "missing_index_stats": "instance_id string, index_group_handle int, index_handle int, avg_total_user_cost double, avg_user_impact double, user_seeks bigint, user_scans bigint",
    "missing_index_details": "instance_id string, index_handle int, database_id int, object_id int, statement string, equality_columns string, inequality_columns string, included_columns string",
    "objects": "instance_id string, database_id int, object_id int, schema_id int, name string, is_ms_shipped boolean, type string, type_desc string",
    "schemas": "instance_id string, database_id int, schema_id int, name string",
    "indexes": "instance_id string, database_id int, object_id int, index_id int, name string, type_desc string, fill_factor int, is_primary_key boolean, is_disabled boolean",
    "index_usage": "instance_id string, database_id int, object_id int, index_id int, user_seeks bigint, user_scans bigint, user_lookups bigint, user_updates bigint, system_seeks bigint, system_scans bigint, system_lookups bigint, last_user_seek timestamp_ntz, last_user_scan timestamp_ntz, last_user_lookup timestamp_ntz",
    "index_physical_stats": "instance_id string, database_id int, object_id int, index_id int, avg_fragmentation_in_percent double, avg_page_space_used_in_percent double, page_count bigint",
    "index_operational_stats": "instance_id string, database_id int, object_id int, index_id int, row_lock_wait_in_ms bigint, row_lock_wait_count bigint, page_latch_wait_in_ms bigint, page_latch_wait_count bigint, page_io_latch_wait_in_ms bigint, page_io_latch_wait_count bigint, index_lock_promotion_attempt_count bigint, index_lock_promotion_count bigint, leaf_allocation_count bigint, nonleaf_allocation_count bigint, leaf_insert_count bigint, leaf_delete_count bigint, leaf_update_count bigint, leaf_ghost_count bigint, range_scan_count bigint, singleton_lookup_count bigint",
    "partition_stats": "instance_id string, database_id int, object_id int, index_id int, partition_number int, used_page_count bigint, reserved_page_count bigint, row_count bigint",
    "index_row_counts": "instance_id string, database_id int, object_id int, index_id int, name string, rowcnt bigint, rowmodctr bigint, stats_date timestamp_ntz",
    "missing_index_groups": "instance_id string, index_group_handle int, index_handle int",
    "event_targets": "instance_id string, session_name string, target_name string, target_data string",
    "sysobjects": "instance_id string, database_id int, id bigint, name string, xtype string",
    "dependencies": "instance_id string, database_id int, id bigint, depid bigint",
    "module_objects": "instance_id string, database_id int, object_id bigint, name string, type string",
    "sql_modules": "instance_id string, database_id int, object_id bigint, definition string",
    "procedures": "instance_id string, database_id int, object_id bigint, name string, type_desc string",
    "procedure_stats": "instance_id string, database_id int, object_id bigint, execution_count bigint",
    "columns_inventory": "instance_id string, database_id int, table_schema string, table_name string, column_name string, data_type string, character_maximum_length int, numeric_precision int, numeric_scale int",
    "file_stats": "instance_id string, database_id int, file_id int, num_of_reads bigint, num_of_writes bigint, io_stall_read_ms bigint, io_stall_write_ms bigint, io_stall bigint, num_of_bytes_read bigint, num_of_bytes_written bigint",
    "database_files": "instance_id string, database_id int, file_id int, name string, physical_name string, size bigint, space_used bigint",
    "db_size_counters": "instance_id string, object_name string, counter_name string, instance_name string, cntr_value bigint",
    "file_space_usage": "instance_id string, file_id int, user_object_reserved_page_count bigint, internal_object_reserved_page_count bigint, version_store_reserved_page_count bigint, mixed_extent_page_count bigint, unallocated_extent_page_count bigint",
    "restore_history": "instance_id string, restore_history_id bigint, destination_database_name string, restore_date timestamp_ntz, restore_type string",
    "system_info": "instance_id string, server_start_time timestamp_ntz",
    "partitions": "instance_id string, database_id int, object_id int, index_id int, partition_id bigint, rows bigint",
    "allocation_units": "instance_id string, database_id int, container_id bigint, type_desc string, total_pages bigint, used_pages bigint",
    "sessions": "instance_id string, session_id int, login_name string, host_name string, program_name string, is_user_process boolean, user_id int",
    "connections": "instance_id string, session_id int, most_recent_session_id int, connection_id string, most_recent_sql_handle string, last_read timestamp_ntz, last_write timestamp_ntz",
    "requests": "instance_id string, session_id int, blocking_session_id int, connection_id string, status string, wait_type string, last_wait_type string, sql_handle string, plan_handle string, statement_start_offset int, statement_end_offset int, database_id int, cpu_time bigint, total_elapsed_time bigint, logical_reads bigint, start_time timestamp_ntz, percent_complete double, open_transaction_count int, user_id int",
    "waiting_tasks": "instance_id string, session_id int, wait_type string, wait_duration_ms bigint, blocking_session_id int",
    "session_transactions": "instance_id string, session_id int, transaction_id bigint",
    "session_space": "instance_id string, session_id int, user_objects_alloc_page_count bigint, user_objects_dealloc_page_count bigint, internal_objects_alloc_page_count bigint, internal_objects_dealloc_page_count bigint",
    "task_space": "instance_id string, session_id int, exec_context_id int, user_objects_alloc_page_count bigint, user_objects_dealloc_page_count bigint, internal_objects_alloc_page_count bigint, internal_objects_dealloc_page_count bigint",
    "locks": "instance_id string, resource_database_id int, resource_type string, resource_associated_entity_id bigint, resource_description string, request_session_id int, request_status string, request_mode string",
    "stats_properties": "instance_id string, database_id int, object_id int, stats_id int, modification_counter bigint",
    "index_columns": "instance_id string, database_id int, object_id int, index_id int, key_ordinal int, column_name string, is_descending_key boolean, is_included_column boolean",
    "order_tables": "instance_id string, database_id int, object_id int, table_name string, schema_name string, is_ms_shipped boolean",
    "order_indexes": "instance_id string, database_id int, object_id int, index_id int, index_name string, type_desc string, is_disabled boolean",
    "counter_samples": "instance_id string, object_name string, counter_name string, instance_name string, captured_at timestamp_ntz, cntr_value bigint",
}

_INTEGRAL = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TELEMETRY_SCHEMAS[table])


def _compatible(expected: str, actual: str) -> bool:
    if expected == actual:
        return True
    if {expected, actual} <= {"timestamp", "timestamp_ntz"}:
        return True
    if expected in _INTEGRAL and actual in _INTEGRAL:
        return _INTEGRAL[actual] >= _INTEGRAL[expected]
    return False


def check_schema(df: DataFrame, table: str) -> DataFrame:
    """Raise if ``df`` lacks a column of ``table`` or holds it with an
    incompatible type; return ``df`` unchanged otherwise."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = []
    for f in schema_of(table).fields:
        want = f.dataType.simpleString()
        if f.name not in have:
            problems.append(f"missing {f.name} {want}")
        elif not _compatible(want, have[f.name]):
            problems.append(f"{f.name} is {have[f.name]}, expected {want}")
    if problems:
        raise ValueError(f"telemetry table {table}: " + "; ".join(problems))
    return df
