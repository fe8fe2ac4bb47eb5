"""Stand-in telemetry derived from the test tables.

These views only give rows in the schema the reports expect; they compute
none of a report's results.  Each view is one SQL text run by Spark (through
``spark.sql`` with the test tables bound as DataFrames) and by the DuckDB
oracle (as a CTE), so both sides start from identical telemetry.

Template syntax: ``{name}`` is a base or derived table; ``TS'...'`` is a
timestamp-without-time-zone literal.  Doubles are floored to BIGINT on
purpose, so the two engines compare exactly.

Fleet mapping: an entity with key ``k`` lives on instance ``'srv' || k % 4``
and customer ``c`` is database ``floor(c / 4)`` of instance ``'srv' || c % 4``,
so statements, texts, plans, sessions and catalogs of one server link up.
Server-level views with no such links (waits, counters, temp space, start
times) put one server per 50 customers or 10 users instead, so the number of
servers, and with it those views, grows with the data.
"""

from __future__ import annotations

import re

PRE_CAPTURE = "2024-01-16 00:00:00"
POST_CAPTURE = "2024-02-01 00:00:00"


def _query_stats(cut: str) -> str:
    where = f"WHERE ts < TS'{cut}'" if cut == PRE_CAPTURE else ""   # the last capture has seen every event
    return f"""
SELECT concat('srv', CAST(user_id % 4 AS STRING)) AS instance_id, TS'{cut}' AS captured_at,
  CAST(user_id AS STRING) AS sql_handle, concat(CAST(user_id AS STRING), '-', event_type) AS plan_handle,
  concat('qh', CAST(user_id % 37 AS STRING)) AS query_hash, concat('qph', CAST(user_id % 41 AS STRING), event_type) AS query_plan_hash,
  CAST(2 * (user_id % 10) AS INT) AS statement_start_offset,
  CAST(CASE WHEN user_id % 4 = 0 THEN -1 ELSE 2 * (user_id % 10) + 40 END AS INT) AS statement_end_offset,
  count(*) AS execution_count,
  CAST(sum(event_id % 3) AS BIGINT) AS plan_generation_num,
  CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total_worker_time,
  CAST(sum(CAST(floor(value * 1000) AS BIGINT) + event_id % 5000) AS BIGINT) AS total_elapsed_time,
  max_by(CAST(floor(value * 1000) AS BIGINT), event_id) AS last_worker_time,
  max_by(CAST(floor(value * 1000) AS BIGINT) + event_id % 5000, event_id) AS last_elapsed_time,
  CAST(sum(event_id % 1000) AS BIGINT) AS total_logical_reads,
  CAST(sum(event_id % 77) AS BIGINT) AS total_logical_writes,
  CAST(sum(event_id % 13) AS BIGINT) AS total_physical_reads,
  max_by(event_id % 1000, event_id) AS last_logical_reads,
  max_by(event_id % 77, event_id) AS last_logical_writes,
  max_by(event_id % 13, event_id) AS last_physical_reads,
  CAST(sum(event_id % 7) AS BIGINT) AS total_clr_time,
  max_by(event_id % 7, event_id) AS last_clr_time, min(event_id % 7) AS min_clr_time, max(event_id % 7) AS max_clr_time,
  min(CAST(floor(value * 1000) AS BIGINT)) AS min_worker_time, max(CAST(floor(value * 1000) AS BIGINT)) AS max_worker_time,
  min(CAST(floor(value * 1000) AS BIGINT) + event_id % 5000) AS min_elapsed_time,
  max(CAST(floor(value * 1000) AS BIGINT) + event_id % 5000) AS max_elapsed_time,
  min(event_id % 13) AS min_physical_reads, max(event_id % 13) AS max_physical_reads,
  min(event_id % 77) AS min_logical_writes, max(event_id % 77) AS max_logical_writes,
  min(event_id % 1000) AS min_logical_reads, max(event_id % 1000) AS max_logical_reads,
  CAST(sum(event_id % 50) AS BIGINT) AS total_rows, max_by(event_id % 50, event_id) AS last_rows,
  min(event_id % 50) AS min_rows, max(event_id % 50) AS max_rows,
  CAST(sum(1 + event_id % 4) AS BIGINT) AS total_dop,
  min(ts) AS creation_time, max(ts) AS last_execution_time
FROM {{events}} {where} GROUP BY user_id, event_type"""


_PLAN_XML = """concat('<ShowPlanXML xmlns="urn:example:showplan"><BatchSequence><Batch><Statements>',
  '<StmtSimple StatementText="SELECT * FROM t', CAST(user_id AS STRING), ' WHERE kind = ', event_type, '">',
  '<QueryPlan CachedPlanSize="', CAST(16 + user_id % 48 AS STRING), '" CompileTime="', CAST(count(*) % 11 AS STRING),
  '" CompileCPU="', CAST(count(*) % 7 AS STRING), '" CompileMemory="', CAST(100 + user_id % 300 AS STRING), '">',
  CASE WHEN user_id % 5 = 0 THEN concat('<MissingIndexes>',
    '<MissingIndexGroup Impact="', CAST(10 + user_id % 90 AS STRING), '.5"><MissingIndex Database="[db', CAST(user_id % 3 AS STRING),
    ']" Schema="[dbo]" Table="[t', CAST(user_id AS STRING), ']">',
    '<ColumnGroup Usage="EQUALITY"><Column Name="[c', CAST(user_id % 4 AS STRING), ']"/><Column Name="[kind]"/></ColumnGroup>',
    CASE WHEN user_id % 2 = 0 THEN '<ColumnGroup Usage="INEQUALITY"><Column Name="[ts]"/></ColumnGroup>' ELSE '' END,
    CASE WHEN count(*) % 2 = 0 THEN '<ColumnGroup Usage="INCLUDE"><Column Name="[value]"/><Column Name="[props]"/></ColumnGroup>' ELSE '' END,
    '</MissingIndex></MissingIndexGroup>',
    CASE WHEN count(*) % 3 = 0 THEN concat('<MissingIndexGroup Impact="', CAST(count(*) % 50 AS STRING), '"><MissingIndex Database="[db',
      CAST(user_id % 3 AS STRING), ']" Schema="[dbo]" Table="[t', CAST(user_id AS STRING), ']"><ColumnGroup Usage="INEQUALITY"><Column Name="[value]"/></ColumnGroup></MissingIndex></MissingIndexGroup>')
      ELSE '' END,
    '</MissingIndexes>') ELSE '' END,
  CASE WHEN user_id % 4 = 2 THEN '<Warnings><ColumnsWithNoStatistics><ColumnReference Column="kind"/></ColumnsWithNoStatistics></Warnings>' ELSE '' END,
  '<RelOp NodeId="0" PhysicalOp="', CASE WHEN event_type = 'view' THEN 'Table Scan' ELSE 'Index Seek' END, '" Parallel="', CAST(count(*) % 2 AS STRING), '">',
  CASE WHEN user_id % 3 = 1 THEN '<ScalarOperator ScalarString="CONVERT_IMPLICIT(int,[kind],0)"/>' ELSE '' END,
  CASE WHEN event_type = 'view' THEN '<TableScan Ordered="0"/>' ELSE '<IndexScan Ordered="1"/>' END,
  '<RelOp NodeId="1" PhysicalOp="Compute Scalar" Parallel="0"/></RelOp>',
  '</QueryPlan></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>')"""


def _wait_stats(cut: str | None) -> str:
    # one server per 50 customers (the fleet grows with the data), ~60 wait types each
    where = f"WHERE o_orderdate < TS'{cut}'" if cut else ""
    return f"""
SELECT concat('srv', CAST(CAST(floor(o_custkey / 50) AS BIGINT) AS STRING)) AS instance_id,
  CASE o_orderkey % 60 WHEN 0 THEN 'SLEEP_TASK' WHEN 1 THEN 'LAZYWRITER_SLEEP' WHEN 2 THEN 'WAITFOR'
    WHEN 3 THEN 'CXCONSUMER' WHEN 4 THEN 'XE_TIMER_EVENT' WHEN 5 THEN 'BROKER_TASK_STOP'
    WHEN 6 THEN 'CUSTOM_SLEEP' WHEN 7 THEN 'SOS_WORK_DISPATCHER' WHEN 9 THEN 'SLEEP_CUSTOM_WAKE'
    ELSE concat('WAIT_', CAST(o_orderkey % 60 AS STRING)) END AS wait_type,
  count(CASE WHEN o_orderkey % 60 <> 8 THEN 1 END) AS waiting_tasks_count,
  CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS wait_time_ms,
  max(CAST(floor(o_totalprice) AS BIGINT)) AS max_wait_time_ms,
  CAST(sum(o_orderkey % 1000) AS BIGINT) AS signal_wait_time_ms
FROM {{orders}} {where} GROUP BY CAST(floor(o_custkey / 50) AS BIGINT), o_orderkey % 60"""


def _perf_counters(cut: str) -> str:
    where = f"WHERE ts < TS'{cut}'" if cut == PRE_CAPTURE else ""
    # one server per ten users; within it each user is one (counter, instance_name) pair per object
    return f"""
SELECT concat('srv', CAST(CAST(floor(user_id / 10) AS BIGINT) AS STRING)) AS instance_id, TS'{cut}' AS captured_at,
  event_type AS object_name, concat('counter_', CAST(user_id % 3 AS STRING)) AS counter_name,
  CASE WHEN user_id % 20 = 0 THEN NULL ELSE concat('u', CAST(user_id % 20 AS STRING)) END AS instance_name,
  CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS cntr_value, CAST(65792 AS INT) AS cntr_type
FROM {{events}} {where} GROUP BY user_id, event_type"""


def _missing_indexes(pre: bool) -> str:
    seeks = "CAST(floor((p_partkey % 17) / 2) AS BIGINT)" if pre else "p_partkey % 17"
    cost = "CAST(p_size - p_partkey % 2 AS DOUBLE)" if pre else "CAST(p_size AS DOUBLE)"
    where = "WHERE p_partkey % 3 <> 0" if pre else ""
    return f"""
SELECT concat('srv', CAST(p_partkey % 4 AS STRING)) AS instance_id, CAST(p_partkey AS INT) AS index_group_handle,
  CAST(p_partkey AS INT) AS index_handle, {cost} AS avg_total_user_cost,
  CAST(p_partkey % 100 AS DOUBLE) AS avg_user_impact, {seeks} AS user_seeks, p_partkey % 5 AS user_scans
FROM {{part}} {where}"""


# module ids repeat from database to database: (instance, database, id) names one module
_MODULE = ("concat('srv', CAST({k} % 4 AS STRING)) AS instance_id, CAST(1 + CAST(floor({k} / 4) AS BIGINT) % 3 AS INT) AS database_id,"
           " {off}CAST(floor({k} / 12) AS BIGINT) AS {id}")


def _module(k: str, name: str, off: str = "") -> str:
    return _MODULE.format(k=k, id=name, off=off)


_OBJ_KEY = "concat('srv', CAST({k} % 4 AS STRING)) AS instance_id, CAST(1 + {k} % 3 AS INT) AS database_id, CAST({k} AS INT) AS object_id"


def _index_operational_stats(cut: str | None) -> str:
    where = f"WHERE l_shipdate < TS'{cut}'" if cut else ""
    return f"""
SELECT {_OBJ_KEY.format(k='l_partkey')}, CAST(l_suppkey % 5 AS INT) AS index_id,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS row_lock_wait_in_ms,
  count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS row_lock_wait_count,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS page_latch_wait_in_ms,
  count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS page_latch_wait_count,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS page_io_latch_wait_in_ms,
  count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS page_io_latch_wait_count,
  count(*) AS index_lock_promotion_attempt_count,
  count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS index_lock_promotion_count,
  count(CASE WHEN l_linenumber > 2 THEN 1 END) AS leaf_allocation_count,
  count(CASE WHEN l_linenumber > 5 THEN 1 END) AS nonleaf_allocation_count,
  CAST(sum(l_linenumber) AS BIGINT) AS leaf_insert_count,
  count(CASE WHEN l_discount > 0.05 THEN 1 END) AS leaf_delete_count,
  count(CASE WHEN l_tax > 0.04 THEN 1 END) AS leaf_update_count,
  count(CASE WHEN l_discount = 0 THEN 1 END) AS leaf_ghost_count,
  CAST(sum(l_linenumber % 3) AS BIGINT) AS range_scan_count,
  CAST(sum(l_orderkey % 7) AS BIGINT) AS singleton_lookup_count
FROM {{lineitem}} {where} GROUP BY l_partkey, l_suppkey % 5"""


def _index_usage(cut: str | None) -> str:
    where = f"WHERE l_shipdate < TS'{cut}'" if cut else ""
    return f"""
SELECT {_OBJ_KEY.format(k='l_partkey')}, CAST(l_suppkey % 5 AS INT) AS index_id,
  count(CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 <> 4 THEN 1 END) AS user_seeks,
  count(CASE WHEN l_returnflag = 'A' AND l_suppkey % 5 <> 4 THEN 1 END) AS user_scans,
  count(CASE WHEN l_returnflag = 'N' AND l_suppkey % 5 <> 4 THEN 1 END) AS user_lookups,
  count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS user_updates,
  count(CASE WHEN l_linenumber = 7 THEN 1 END) AS system_seeks,
  count(CASE WHEN l_linenumber = 6 AND l_partkey % 2 = 0 THEN 1 END) AS system_scans,
  count(CASE WHEN l_linenumber = 5 AND l_partkey % 3 = 0 THEN 1 END) AS system_lookups,
  max(CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 <> 4 THEN l_shipdate END) AS last_user_seek,
  max(CASE WHEN l_returnflag = 'A' AND l_suppkey % 5 <> 4 THEN l_shipdate END) AS last_user_scan,
  max(CASE WHEN l_returnflag = 'N' AND l_suppkey % 5 <> 4 THEN l_shipdate END) AS last_user_lookup
FROM {{lineitem}} {where} GROUP BY l_partkey, l_suppkey % 5"""


def _index_row_counts(cut: str | None) -> str:
    where = f"WHERE l_shipdate < TS'{cut}'" if cut else ""
    return f"""
SELECT {_OBJ_KEY.format(k='l_partkey')}, CAST(l_linenumber - 1 AS INT) AS index_id,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('ix', CAST(l_linenumber - 1 AS STRING)) END AS name,
  count(*) * 150 AS rowcnt, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS rowmodctr,
  max(l_shipdate) AS stats_date
FROM {{lineitem}} {where} GROUP BY l_partkey, l_linenumber"""


VIEWS: dict[str, str] = {
    # ---- statements and cached plans -------------------------------------------------
    "query_stats": _query_stats(POST_CAPTURE),
    "query_stats_pre": _query_stats(PRE_CAPTURE),
    # both captures landed in one table, as a fleet collector appends them
    "query_stats_captures": f"""
{_query_stats(PRE_CAPTURE)}
UNION ALL
{_query_stats(POST_CAPTURE)}""",
    # batch texts: each document behind a statement head, so searches for writes find some; some with characters beyond the BMP
    "sql_texts": """
SELECT concat('srv', CAST(doc_id % 4 AS STRING)) AS instance_id, CAST(doc_id AS STRING) AS sql_handle,
  concat(CASE doc_id % 4 WHEN 0 THEN concat('INSERT INTO t', CAST(doc_id % 7 AS STRING), ' ')
    WHEN 1 THEN concat('UPDATE t', CAST(doc_id % 7 AS STRING), ' SET ')
    WHEN 2 THEN concat('DELETE t', CAST(doc_id % 7 AS STRING), ' WHERE ') ELSE 'SELECT ' END,
    CASE WHEN doc_id % 11 = 5 THEN '😀🚀 ' ELSE '' END, text) AS text
FROM {documents}""",
    "query_plans": f"""
SELECT concat('srv', CAST(user_id % 4 AS STRING)) AS instance_id, concat(CAST(user_id AS STRING), '-', event_type) AS plan_handle,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 3 AS INT) END AS dbid,
  CAST(user_id % 50 AS INT) AS objectid,
  {_PLAN_XML} AS query_plan
FROM {{events}} GROUP BY user_id, event_type""",
    "cached_plans": f"""
SELECT concat('srv', CAST(user_id % 4 AS STRING)) AS instance_id, concat(CAST(user_id AS STRING), '-', event_type) AS plan_handle,
  CAST(user_id AS STRING) AS sql_handle,
  CASE WHEN count(*) % 6 = 0 THEN 'Compiled Plan Stub' ELSE 'Compiled Plan' END AS cacheobjtype,
  CASE WHEN user_id % 2 = 0 THEN 'Adhoc' ELSE 'Proc' END AS objtype,
  count(*) AS usecounts, CAST(user_id % 5 AS INT) AS attribute_dbid
FROM {{events}} GROUP BY user_id, event_type""",
    "databases": """
SELECT concat('srv', CAST(c_custkey % 4 AS STRING)) AS instance_id, CAST(floor(c_custkey / 4) AS INT) AS database_id,
  concat('db_', CAST(c_custkey AS STRING)) AS name, d.create_date,
  c_custkey % 2 = 0 AS is_auto_create_stats_on, c_custkey % 3 <> 0 AS is_auto_update_stats_on,
  c_custkey % 5 = 0 AS is_auto_update_stats_async_on, CAST(100 + 10 * (c_custkey % 6) AS INT) AS compatibility_level,
  c_mktsegment AS collation_name
FROM {customer} LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS create_date FROM {orders} GROUP BY o_custkey) d
  ON c_custkey = d.o_custkey""",
}

VIEWS.update({
    # ---- waits, counters, missing indexes (two captures each) ------------------------
    "wait_stats": _wait_stats(None),
    "wait_stats_pre": _wait_stats("1998-01-01 00:00:00"),
    "perf_counters": _perf_counters(POST_CAPTURE),
    "perf_counters_pre": _perf_counters(PRE_CAPTURE),
    "missing_index_stats": _missing_indexes(False),
    "missing_index_stats_pre": _missing_indexes(True),
    "missing_index_details": """
SELECT concat('srv', CAST(p_partkey % 4 AS STRING)) AS instance_id, CAST(p_partkey AS INT) AS index_handle,
  CAST(p_partkey % 3 AS INT) AS database_id, CAST(p_partkey % 200 AS INT) AS object_id,
  concat('[db', CAST(p_partkey % 3 AS STRING), '].[dbo].[', p_brand, ']') AS statement,
  concat('[', p_type, ']') AS equality_columns,
  CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE '[p_size]' END AS inequality_columns,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '[p_name], [p_retailprice]' END AS included_columns
FROM {part}""",
})

VIEWS.update({
    # ---- index catalog and index statistics ------------------------------------------
    "objects": f"""
SELECT {_OBJ_KEY.format(k='p_partkey')}, CAST(p_partkey % 8 AS INT) AS schema_id, concat('t', CAST(p_partkey AS STRING)) AS name,
  p_partkey % 25 = 0 AS is_ms_shipped, CASE WHEN p_partkey % 25 = 0 THEN 'S' ELSE 'U' END AS type,
  CASE WHEN p_partkey % 25 = 0 THEN 'SYSTEM_TABLE' ELSE 'USER_TABLE' END AS type_desc
FROM {{part}}""",
    "schemas": """
SELECT DISTINCT concat('srv', CAST(p_partkey % 4 AS STRING)) AS instance_id, CAST(1 + p_partkey % 3 AS INT) AS database_id,
  CAST(p_partkey % 8 AS INT) AS schema_id, CASE WHEN p_partkey % 8 = 0 THEN 'dbo' ELSE concat('s', CAST(p_partkey % 8 AS STRING)) END AS name
FROM {part}""",
    "indexes": f"""
SELECT DISTINCT {_OBJ_KEY.format(k='l_partkey')}, CAST(l_linenumber - 1 AS INT) AS index_id,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('ix', CAST(l_linenumber - 1 AS STRING)) END AS name,
  CASE WHEN l_linenumber = 1 THEN 'HEAP' WHEN l_linenumber = 2 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END AS type_desc,
  CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE 78 + l_linenumber + CAST(l_partkey % 3 AS INT) END AS INT) AS fill_factor,
  l_linenumber = 2 AS is_primary_key, l_linenumber = 7 AS is_disabled
FROM {{lineitem}}""",
    "index_usage": _index_usage(None),
    "index_usage_pre": _index_usage("1997-01-01 00:00:00"),
    "index_physical_stats": """
SELECT instance_id, database_id, object_id, index_id,
  CAST((user_updates * 3700 + object_id * 13) % 10000 AS DOUBLE) / 100 AS avg_fragmentation_in_percent,
  CAST((user_seeks * 3100 + object_id * 7) % 10000 AS DOUBLE) / 100 AS avg_page_space_used_in_percent,
  user_updates * 500 + object_id AS page_count
FROM {index_usage}""",
    "index_operational_stats": _index_operational_stats(None),
    "index_operational_stats_pre": _index_operational_stats("1997-01-01 00:00:00"),
    "partition_stats": f"""
SELECT {_OBJ_KEY.format(k='l_partkey')}, CAST(l_suppkey % 5 AS INT) AS index_id, CAST(l_linenumber AS INT) AS partition_number,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) - CASE WHEN l_suppkey % 5 = 3 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) ELSE 0 END AS used_page_count,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) + 8 AS reserved_page_count, count(*) AS row_count
FROM {{lineitem}} GROUP BY l_partkey, l_suppkey % 5, l_linenumber""",
    "index_row_counts": _index_row_counts(None),
    "index_row_counts_pre": _index_row_counts("1997-01-01 00:00:00"),
    "missing_index_groups": """
SELECT concat('srv', CAST(p_partkey % 4 AS STRING)) AS instance_id, CAST(p_partkey AS INT) AS index_group_handle,
  CAST(p_partkey AS INT) AS index_handle
FROM {part}""",
})

VIEWS.update({
    # ---- extended-event ring buffers with deadlock reports ---------------------------
    # One ring-buffer document per (instance, block of ten conversations); each
    # conversation is one deadlock event, each turn one process (turn 3 has no frame).
    # Events differ in the order of their attributes, in the form of their time, and in text that looks like markup.
    "deadlock_processes_true": """
SELECT conv_id, turn, CAST(floor(conv_id / 10) AS BIGINT) AS b, concat('p', CAST(turn AS STRING)) AS process_id,
  CASE WHEN turn = 3 THEN NULL ELSE CAST(4 * turn + CAST(floor(conv_id / 10) AS BIGINT) % 4 AS STRING) END AS handle,
  CASE WHEN turn = 3 THEN NULL ELSE CAST(2 * turn AS INT) END AS stmtstart,
  CASE WHEN turn <> 3 AND turn % 2 = 0 THEN CAST(2 * turn + 60 AS INT) END AS stmtend
FROM {conversations}""",
    "deadlock_reports": """
SELECT conv_id, b, concat('srv', CAST(b % 4 AS STRING)) AS instance_id, stamp,
  CASE WHEN conv_id % 5 = 0 THEN concat('p1', chr(92), 'r', chr(92), 'n', 'p2') ELSE 'p1' END AS victim_ids,
  concat(CASE conv_id % 3 WHEN 0 THEN concat('<event name="xml_deadlock_report" package="engine" timestamp="', written, '">')
      WHEN 1 THEN concat('<event timestamp="', written, '" package="a > b" name="xml_deadlock_report">')
      ELSE concat('<event package="engine"  name="xml_deadlock_report" timestamp="', written, '" >') END,
    CASE WHEN conv_id % 4 = 2 THEN '<action name="note"><value><![CDATA[ </event> <event name="x"> ]]></value></action><!-- </event> -->' ELSE '' END,
    '<data name="xml_report"><value><deadlock><victim-list><victimProcess id="p1"/>',
    CASE WHEN conv_id % 5 = 0 THEN '<victimProcess id="p2"/>' ELSE '' END, '</victim-list><process-list>', procs,
    '</process-list></deadlock></value></data></event>') AS ev
FROM (
  SELECT conv_id, b, concat('2024-01-', lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0'), ' ', lpad(CAST(conv_id % 24 AS STRING), 2, '0'), ':',
      lpad(CAST(conv_id % 60 AS STRING), 2, '0'), ':00') AS stamp,
    concat('2024-01-', lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0'), 'T', lpad(CAST(conv_id % 24 AS STRING), 2, '0'), ':',
      lpad(CAST(conv_id % 60 AS STRING), 2, '0'), CASE conv_id % 4 WHEN 0 THEN ':00.000Z' WHEN 1 THEN ':00Z' WHEN 2 THEN ':00.0000000Z' ELSE ':00' END) AS written,
    listagg(proc, '') WITHIN GROUP (ORDER BY turn) AS procs
  FROM (
    SELECT conv_id, b, turn,
      CASE WHEN handle IS NULL THEN concat('<process id="', process_id, '"/>')
      ELSE concat('<process id="', process_id, '" waittime="', CAST(100 * turn AS STRING),
        '"><executionStack><frame sqlhandle="', handle, '" stmtstart="', CAST(stmtstart AS STRING), '"',
        CASE WHEN stmtend IS NOT NULL THEN concat(' stmtend="', CAST(stmtend AS STRING), '"') ELSE '' END,
        '/></executionStack></process>') END AS proc
    FROM {deadlock_processes_true}) p
  GROUP BY conv_id, b) e""",
    "event_targets": """
SELECT concat('srv', CAST(b % 4 AS STRING)) AS instance_id, 'system_health' AS session_name, 'ring_buffer' AS target_name,
  concat('<RingBufferTarget truncated="0" eventCount="', CAST(count(*) + 2 AS STRING), '">',
    '<event name="heartbeat" timestamp="2024-02-01T00:00:00.000Z"/>',
    listagg(ev, '') WITHIN GROUP (ORDER BY conv_id),
    '<event name="component_result" package="engine" timestamp="2024-02-01T00:00:00.000Z">',
    '<data name="state"><value>1</value></data></event></RingBufferTarget>') AS target_data
FROM {deadlock_reports} GROUP BY b""",
})

VIEWS.update({
    # ---- modules, dependencies, procedures, columns ----------------------------------
    "sysobjects": f"""
SELECT {_module('s_suppkey', 'id')}, concat('usp_', CAST(s_suppkey AS STRING)) AS name, 'P' AS xtype FROM {{supplier}}
UNION ALL
SELECT {_module('p_partkey', 'id', '1000000 + ')}, concat('t', CAST(p_partkey AS STRING)) AS name, 'U' AS xtype FROM {{part}}""",
    "dependencies": f"""
SELECT {_module('l_suppkey', 'id')}, 1000000 + CAST(floor(l_partkey / 12) AS BIGINT) AS depid FROM {{lineitem}}""",
    "module_objects": f"""
SELECT {_module('doc_id', 'object_id')}, concat('m', CAST(doc_id AS STRING)) AS name,
  CASE doc_id % 7 WHEN 0 THEN 'V' WHEN 1 THEN 'FN' WHEN 2 THEN 'IF' WHEN 3 THEN 'P' WHEN 4 THEN 'TF' ELSE 'TR' END AS type
FROM {{documents}}""",
    "sql_modules": f"""
SELECT {_module('doc_id', 'object_id')}, text AS definition FROM {{documents}}""",
    # suppliers' procedures have run, customers' have not
    "procedures": f"""
SELECT {_module('s_suppkey', 'object_id')}, concat('usp_', CAST(s_suppkey AS STRING)) AS name, 'SQL_STORED_PROCEDURE' AS type_desc FROM {{supplier}}
UNION ALL
SELECT {_module('c_custkey', 'object_id', '500000 + ')}, concat('usp_c', CAST(c_custkey AS STRING)) AS name, 'SQL_STORED_PROCEDURE' AS type_desc
FROM {{customer}}""",
    # every seventh supplier's procedure only ran under its id in another database
    "procedure_stats": f"""
SELECT instance_id, CASE WHEN l_suppkey % 7 = 3 THEN database_id % 3 + 1 ELSE database_id END AS database_id, object_id, count(*) AS execution_count
FROM (SELECT {_module('l_suppkey', 'object_id')}, l_suppkey FROM {{lineitem}}) x GROUP BY instance_id, database_id, object_id, l_suppkey""",
    "columns_inventory": """
SELECT DISTINCT concat('srv', CAST(p_partkey % 4 AS STRING)) AS instance_id, CAST(1 + CAST(floor(p_partkey / 4) AS BIGINT) % 3 AS INT) AS database_id,
  CASE WHEN p_size % 7 = 0 THEN 'sales' ELSE 'dbo' END AS table_schema,
  p_brand AS table_name, split_part(p_name, ' ', 1) AS column_name,
  CASE WHEN p_size < 40 THEN 'int' ELSE lower(split_part(p_type, ' ', 3)) END AS data_type,
  CASE WHEN p_size < 40 THEN NULL ELSE CAST(p_size AS INT) END AS character_maximum_length,
  CASE WHEN p_size < 40 THEN CAST(10 + p_size % 2 AS INT) ELSE NULL END AS numeric_precision,
  CASE WHEN p_size < 40 THEN CAST(0 AS INT) ELSE NULL END AS numeric_scale
FROM {part}""",
    # ---- files, space, restores, start times -----------------------------------------
    "file_stats": """
SELECT concat('srv', CAST(l_suppkey % 4 AS STRING)) AS instance_id, CAST(1 + l_suppkey % 3 AS INT) AS database_id,
  CAST(l_suppkey AS INT) AS file_id,
  count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS num_of_reads, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS num_of_writes,
  CAST(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS io_stall_read_ms,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS io_stall_write_ms,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) + count(*) AS io_stall,
  CAST(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS num_of_bytes_read,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS num_of_bytes_written
FROM {lineitem} GROUP BY l_suppkey""",
    "database_files": """
SELECT concat('srv', CAST(s_suppkey % 4 AS STRING)) AS instance_id, CAST(1 + s_suppkey % 3 AS INT) AS database_id,
  CAST(s_suppkey AS INT) AS file_id, concat('f', CAST(s_suppkey AS STRING)) AS name,
  concat(CASE s_suppkey % 3 WHEN 0 THEN 'c:' WHEN 1 THEN 'D:' ELSE 'e:' END, '/data/f', CAST(s_suppkey AS STRING), '.mdf') AS physical_name,
  CAST(floor(abs(s_acctbal)) AS BIGINT) + 20000 AS size, CAST(floor(abs(s_acctbal)) AS BIGINT) AS space_used
FROM {supplier}""",
    "db_size_counters": """
SELECT concat('srv', CAST(o_custkey % 4 AS STRING)) AS instance_id, 'Engine:Databases   ' AS object_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Data File(s) Size (KB)' WHEN '2-HIGH' THEN 'Log File(s) Size (KB)'
    WHEN '3-MEDIUM' THEN 'Log File(s) Used Size (KB)' ELSE 'Percent Log Used' END AS counter_name,
  concat('db_', CAST(o_custkey AS STRING)) AS instance_name, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS cntr_value
FROM {orders} GROUP BY o_custkey, o_orderpriority""",
    "file_space_usage": """
SELECT concat('srv', CAST(CAST(floor(o_custkey / 50) AS BIGINT) AS STRING)) AS instance_id, CAST(o_custkey % 50 AS INT) AS file_id,
  CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 8 END) AS BIGINT) AS user_object_reserved_page_count,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 8 END) AS BIGINT) AS internal_object_reserved_page_count,
  CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 8 END) AS BIGINT) AS version_store_reserved_page_count,
  CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS BIGINT) AS mixed_extent_page_count,
  CAST(sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 16 END) AS BIGINT) AS unallocated_extent_page_count
FROM {orders} GROUP BY o_custkey""",
    # every third database was never restored: its restores went into the one before
    "restore_history": """
SELECT concat('srv', CAST(k % 4 AS STRING)) AS instance_id, o_orderkey AS restore_history_id,
  concat('db_', CAST(k AS STRING)) AS destination_database_name, o_orderdate AS restore_date, o_orderpriority AS restore_type
FROM (SELECT *, CASE WHEN o_custkey % 3 = 2 THEN o_custkey - 1 ELSE o_custkey END AS k FROM {orders}) o""",
    "system_info": """
SELECT concat('srv', CAST(CAST(floor(o_custkey / 50) AS BIGINT) AS STRING)) AS instance_id, o_orderdate AS server_start_time
FROM {orders}""",
})

# server starts while the captures were taken: none, one or several, the fleet's first servers included
VIEWS["server_starts"] = """
SELECT concat('srv', CAST(CAST(floor(user_id / 10) AS BIGINT) AS STRING)) AS instance_id, ts AS server_start_time
FROM {events} WHERE event_id % 23 = 5 AND CAST(floor(user_id / 10) AS BIGINT) % 3 <> 2"""

VIEWS.update({
    "partitions": f"""
SELECT {_OBJ_KEY.format(k='l_partkey')}, CAST(l_suppkey % 5 AS INT) AS index_id,
  CAST(floor(l_partkey / 12) AS BIGINT) * 10 + l_suppkey % 5 AS partition_id, count(*) AS rows
FROM {{lineitem}} GROUP BY l_partkey, l_suppkey % 5""",
    # container ids repeat from database to database
    "allocation_units": """
SELECT concat('srv', CAST(l_partkey % 4 AS STRING)) AS instance_id, CAST(1 + l_partkey % 3 AS INT) AS database_id,
  CAST(floor(l_partkey / 12) AS BIGINT) * 10 + l_suppkey % 5 AS container_id,
  'IN_ROW_DATA' AS type_desc, CAST(sum(CAST(l_quantity AS BIGINT)) * 40 AS BIGINT) AS total_pages,
  CAST(sum(CAST(l_quantity AS BIGINT)) * 37 AS BIGINT) AS used_pages
FROM {lineitem} GROUP BY l_partkey, l_suppkey % 5
UNION ALL
SELECT concat('srv', CAST(l_partkey % 4 AS STRING)) AS instance_id, CAST(1 + l_partkey % 3 AS INT) AS database_id,
  CAST(floor(l_partkey / 12) AS BIGINT) * 10 + l_suppkey % 5 AS container_id, 'LOB_DATA' AS type_desc, count(*) * 90 AS total_pages, count(*) * 64 AS used_pages
FROM {lineitem} WHERE l_linenumber > 4 GROUP BY l_partkey, l_suppkey % 5""",
})

# Requests: one per customer with orders; orders of every fifth customer belong to the one before, so some sessions run
# nothing.  A session's texts, plan and blocker are other keys of the same instance, spread over all of them.
_REQ_FROM = "FROM (SELECT *, CASE WHEN o_custkey % 5 = 4 THEN o_custkey - 1 ELSE o_custkey END AS k FROM {orders}) o GROUP BY k"
_BLOCKER = "CASE WHEN max(o_orderkey) % 3 = 0 THEN 0 ELSE CAST(4 * CAST(floor(k / 8) AS BIGINT) + k % 4 AS INT) END"


def _text_of(k: str) -> str:   # two texts for every three customers
    return f"CAST(4 * CAST(floor(floor({k} / 4) * 2 / 3) AS BIGINT) + {k} % 4 AS STRING)"


def _user_of(k: str) -> str:   # one user for every ten customers
    return f"CAST(4 * CAST(floor({k} / 40) AS BIGINT) + {k} % 4 AS STRING)"


VIEWS.update({
    # ---- one sample of sessions, connections, requests, waits and locks -------------
    "sessions": """
SELECT concat('srv', CAST(c_custkey % 4 AS STRING)) AS instance_id, CAST(c_custkey AS INT) AS session_id, c_name AS login_name,
  c_mktsegment AS host_name, concat('app', CAST(c_nationkey AS STRING)) AS program_name, c_custkey % 10 <> 0 AS is_user_process,
  CAST(c_nationkey AS INT) AS user_id
FROM {customer}""",
    "connections": f"""
SELECT concat('srv', CAST(c_custkey % 4 AS STRING)) AS instance_id, CAST(c_custkey AS INT) AS session_id,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS INT) END AS most_recent_session_id, concat('cn', CAST(c_custkey AS STRING)) AS connection_id,
  {_text_of('c_custkey')} AS most_recent_sql_handle,
  TS'2024-01-31 12:00:00' AS last_read, TS'2024-01-31 11:00:00' AS last_write
FROM {{customer}}""",
    "requests": f"""
SELECT concat('srv', CAST(k % 4 AS STRING)) AS instance_id, CAST(k AS INT) AS session_id,
  {_BLOCKER} AS blocking_session_id, concat('cn', CAST(k AS STRING)) AS connection_id,
  CASE WHEN count(*) % 2 = 0 THEN 'running' ELSE 'suspended' END AS status,
  CASE WHEN max(o_orderkey) % 3 = 0 THEN NULL ELSE 'LCK_M_X' END AS wait_type, 'PAGEIOLATCH_SH' AS last_wait_type,
  {_text_of('k')} AS sql_handle, concat({_user_of('k')}, '-click') AS plan_handle,
  CAST(2 * (k % 10) AS INT) AS statement_start_offset,
  CAST(CASE WHEN k % 4 = 0 THEN -1 ELSE 2 * (k % 10) + 40 END AS INT) AS statement_end_offset,
  CAST(k % 3 AS INT) AS database_id, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) % 100000 AS BIGINT) AS cpu_time,
  CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_elapsed_time, count(*) * 8 AS logical_reads,
  max(o_orderdate) AS start_time, CAST(count(*) % 100 AS DOUBLE) AS percent_complete,
  CAST(count(*) % 3 AS INT) AS open_transaction_count, CAST(k % 25 AS INT) AS user_id
{_REQ_FROM}""",
    "waiting_tasks": f"""
SELECT concat('srv', CAST(k % 4 AS STRING)) AS instance_id, CAST(k AS INT) AS session_id, 'LCK_M_X' AS wait_type,
  max(CAST(floor(o_totalprice) AS BIGINT)) AS wait_duration_ms, {_BLOCKER} AS blocking_session_id
{_REQ_FROM} HAVING max(o_orderkey) % 3 <> 0""",
    # sessions hold none, one or two transactions
    "session_transactions": """
SELECT concat('srv', CAST(k % 4 AS STRING)) AS instance_id, CAST(k AS INT) AS session_id, c_custkey AS transaction_id
FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE c_custkey END AS k FROM {customer}) c""",
    "session_space": """
SELECT concat('srv', CAST(user_id % 4 AS STRING)) AS instance_id, CAST(user_id AS INT) AS session_id,
  CAST(sum(event_id % 512) AS BIGINT) AS user_objects_alloc_page_count, CAST(sum(event_id % 64) AS BIGINT) AS user_objects_dealloc_page_count,
  CAST(sum(event_id % 128) AS BIGINT) AS internal_objects_alloc_page_count, CAST(sum(event_id % 16) AS BIGINT) AS internal_objects_dealloc_page_count
FROM {events} GROUP BY user_id""",
    "task_space": """
SELECT concat('srv', CAST(user_id % 4 AS STRING)) AS instance_id, CAST(user_id AS INT) AS session_id,
  CAST(event_id % 3 AS INT) AS exec_context_id,
  CAST(sum(event_id % 256) AS BIGINT) AS user_objects_alloc_page_count, CAST(sum(event_id % 32) AS BIGINT) AS user_objects_dealloc_page_count,
  CAST(sum(event_id % 64) AS BIGINT) AS internal_objects_alloc_page_count, CAST(sum(event_id % 8) AS BIGINT) AS internal_objects_dealloc_page_count
FROM {events} GROUP BY user_id, event_id % 3""",
    "locks": """
SELECT DISTINCT concat('srv', CAST(l_partkey % 4 AS STRING)) AS instance_id, CAST(1 + l_partkey % 3 AS INT) AS resource_database_id,
  CASE WHEN l_linenumber = 1 THEN 'OBJECT' ELSE 'KEY' END AS resource_type,
  CASE WHEN l_linenumber = 1 THEN l_partkey ELSE CAST(floor(l_partkey / 12) AS BIGINT) * 10 + l_suppkey % 5 END AS resource_associated_entity_id,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('(', CAST(l_orderkey % 7 AS STRING), ')') END AS resource_description,
  CAST(l_suppkey * 4 + l_partkey % 4 AS INT) AS request_session_id,
  CASE WHEN l_linestatus = 'F' THEN 'GRANT' ELSE 'WAIT' END AS request_status, l_returnflag AS request_mode
FROM {lineitem}""",
})

VIEWS.update({
    "stats_properties": f"""
SELECT {_OBJ_KEY.format(k='l_partkey')}, CAST(l_linenumber AS INT) AS stats_id,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS modification_counter
FROM {{lineitem}} GROUP BY l_partkey, l_linenumber""",
    # index key columns: table = order, index = line number, columns from the supplier key
    "index_columns": """
SELECT DISTINCT concat('srv', CAST(l_orderkey % 4 AS STRING)) AS instance_id, CAST(1 + l_orderkey % 3 AS INT) AS database_id,
  CAST(l_orderkey AS INT) AS object_id, CAST(l_linenumber AS INT) AS index_id, CAST(l_suppkey % 3 AS INT) AS key_ordinal,
  concat('c', CAST(l_suppkey % 3 AS STRING), CASE WHEN l_suppkey % 11 = 0 THEN '_x' ELSE '' END) AS column_name,
  l_suppkey % 3 = 1 AS is_descending_key, l_partkey % 9 = 0 AS is_included_column
FROM {lineitem}""",
    "order_tables": """
SELECT concat('srv', CAST(o_orderkey % 4 AS STRING)) AS instance_id, CAST(1 + o_orderkey % 3 AS INT) AS database_id,
  CAST(o_orderkey AS INT) AS object_id, concat('order_', CAST(o_orderkey AS STRING)) AS table_name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'sales' ELSE 'dbo' END AS schema_name, o_orderstatus = 'P' AS is_ms_shipped
FROM {orders}""",
    "order_indexes": """
SELECT DISTINCT concat('srv', CAST(l_orderkey % 4 AS STRING)) AS instance_id, CAST(1 + l_orderkey % 3 AS INT) AS database_id,
  CAST(l_orderkey AS INT) AS object_id, CAST(l_linenumber AS INT) AS index_id, concat('ix_', CAST(l_linenumber AS STRING)) AS index_name,
  CASE WHEN l_linenumber = 1 THEN 'CLUSTERED' WHEN l_linenumber = 7 THEN 'HEAP' ELSE 'NONCLUSTERED' END AS type_desc,
  l_linenumber = 6 AS is_disabled
FROM {lineitem}""",
})

VIEWS.update({
    # one counter sample per event (the sampler's one-second readings)
    "counter_samples": """
SELECT concat('srv', CAST(user_id % 4 AS STRING)) AS instance_id, event_type AS object_name,
  concat('counter_', CAST(user_id % 3 AS STRING)) AS counter_name,
  CASE WHEN user_id % 20 = 0 THEN NULL ELSE concat('u', CAST(user_id % 20 AS STRING)) END AS instance_name,
  ts AS captured_at, CAST(floor(value * 1000) AS BIGINT) AS cntr_value
FROM {events}""",
})

# Tables as a collector lands them: the captures of one view in one table, told apart by ``captured_at``.  Cumulative views
# have an earlier capture of their own; of a point-in-time view the earlier sample saw part of the later one's rows.
_EARLIER = {
    "wait_stats": "{wait_stats_pre}", "missing_index_stats": "{missing_index_stats_pre}",
    "index_operational_stats": "{index_operational_stats_pre}", "index_row_counts": "{index_row_counts_pre}",
    "index_physical_stats": "{index_physical_stats} WHERE object_id % 2 = 0", "partition_stats": "{partition_stats} WHERE object_id % 2 = 0",
    "stats_properties": "{stats_properties} WHERE object_id % 2 = 0", "procedure_stats": "{procedure_stats} WHERE object_id % 2 = 0",
    "file_stats": "{file_stats} WHERE file_id % 2 = 0", "db_size_counters": "{db_size_counters} WHERE cntr_value % 2 = 0",
    "file_space_usage": "{file_space_usage} WHERE file_id % 2 = 0", "event_targets": "{event_targets} WHERE instance_id <> 'srv1'",
    "sessions": "{sessions} WHERE session_id % 2 = 0", "connections": "{connections} WHERE session_id % 3 <> 1",
    "requests": "{requests} WHERE session_id % 2 = 0", "waiting_tasks": "{waiting_tasks} WHERE session_id % 2 = 0",
    "session_transactions": "{session_transactions} WHERE session_id % 3 <> 1", "session_space": "{session_space} WHERE session_id % 2 = 0",
    "task_space": "{task_space} WHERE session_id % 2 = 0", "locks": "{locks} WHERE request_session_id % 2 = 0",
}
for _name, _source in _EARLIER.items():
    VIEWS[f"{_name}_captures"] = (f"SELECT TS'{PRE_CAPTURE}' AS captured_at, * FROM {_source}\nUNION ALL\n"
                                  f"SELECT TS'{POST_CAPTURE}' AS captured_at, * FROM {{{_name}}}")
VIEWS["perf_counters_captures"] = "SELECT * FROM {perf_counters_pre}\nUNION ALL\nSELECT * FROM {perf_counters}"
# the usage ledger sees a second capture on the first day, after a restart (counters lower than before)
SAME_DAY_CAPTURE = "2024-01-16 18:00:00"
VIEWS["index_usage_restarted"] = _index_usage("1996-01-01 00:00:00")
VIEWS["index_usage_captures"] = (f"SELECT TS'{PRE_CAPTURE}' AS captured_at, * FROM {{index_usage_pre}}\nUNION ALL\n"
                                 f"SELECT TS'{SAME_DAY_CAPTURE}' AS captured_at, * FROM {{index_usage_restarted}}\nUNION ALL\n"
                                 f"SELECT TS'{POST_CAPTURE}' AS captured_at, * FROM {{index_usage}}")
#: Views that are landed with ``captured_at``, one row set per capture.
CAPTURED = frozenset(n.removesuffix("_captures") for n in VIEWS if n.endswith("_captures"))

_REF = re.compile(r"\{(\w+)\}")


def deps_of(name: str) -> list[str]:
    return sorted(set(_REF.findall(VIEWS[name])))


def spark_sql(name: str) -> tuple[str, list[str]]:
    """SQL text for Spark (``{x}`` stays a DataFrame placeholder) and its inputs."""
    sql = VIEWS[name].replace("TS'", "TIMESTAMP_NTZ '")
    return sql, deps_of(name)


_LISTAGG = re.compile(r"listagg\((.*?), ''\) WITHIN GROUP \(ORDER BY (\w+)\)")


def duckdb_sql(name: str) -> str:
    sql = _REF.sub(lambda m: m.group(1), VIEWS[name]).replace("TS'", "TIMESTAMP '")
    return _LISTAGG.sub(lambda m: f"string_agg({m.group(1)}, '' ORDER BY {m.group(2)})", sql)


def duckdb_with(report_sql: str, names: list[str]) -> str:
    """Prefix a report query with the CTEs of the derived views it uses."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n not in VIEWS:
            return
        for d in deps_of(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({duckdb_sql(n)}\n)" for n in order)
    if not ctes:
        return report_sql
    body = report_sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{report_sql}"
