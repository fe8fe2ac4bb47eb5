"""Fixed values that must equal the reference's for right results.

FIXED VALUES (from the reference, kept verbatim and in their original order):
the benign wait types each wait report leaves out.
"""

# Wait types excluded by the top-waits report (67 entries).
TOP_WAITS_BENIGN = (
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH",
    "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT",
    "CLR_SEMAPHORE", "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE", "DBMIRROR_WORKER_QUEUE",
    "DBMIRRORING_CMD", "DIRTY_PAGE_POLL", "DISPATCHER_QUEUE_SEMAPHORE", "EXECSYNC", "FSAGENT",
    "FT_IFTS_SCHEDULER_IDLE_WAIT", "FT_IFTSHC_MUTEX", "HADR_CLUSAPI_CALL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT", "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK", "HADR_WORK_QUEUE", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE",
    "MEMORY_ALLOCATION_EXT", "ONDEMAND_TASK_QUEUE", "PREEMPTIVE_XE_GETTARGETSTATE",
    "PWAIT_ALL_COMPONENTS_INITIALIZED", "PWAIT_DIRECTLOGCONSUMER_GETNEXT",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP", "QDS_ASYNC_QUEUE",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_SHUTDOWN_QUEUE",
    "REDO_THREAD_PENDING_WORK", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE",
    "SERVER_IDLE_CHECK", "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP",
    "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY", "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP",
    "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP", "SNI_HTTP_ACCEPT",
    "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
    "SQLTRACE_WAIT_ENTRIES", "WAIT_FOR_RESULTS", "WAITFOR", "WAITFOR_TASKSHUTDOWN",
    "WAIT_XTP_RECOVERY", "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG",
    "WAIT_XTP_CKPT_CLOSE", "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
)

# Wait types excluded by the Pareto wait report (78 entries).
PARETO_WAITS_BENIGN = (
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH",
    "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT",
    "CLR_SEMAPHORE", "CXCONSUMER", "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE",
    "DBMIRROR_WORKER_QUEUE", "DBMIRRORING_CMD", "DIRTY_PAGE_POLL", "DISPATCHER_QUEUE_SEMAPHORE",
    "EXECSYNC", "FSAGENT", "FT_IFTS_SCHEDULER_IDLE_WAIT", "FT_IFTSHC_MUTEX", "HADR_CLUSAPI_CALL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT", "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK", "HADR_WORK_QUEUE", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE",
    "MEMORY_ALLOCATION_EXT", "ONDEMAND_TASK_QUEUE", "PARALLEL_REDO_DRAIN_WORKER",
    "PARALLEL_REDO_LOG_CACHE", "PARALLEL_REDO_TRAN_LIST", "PARALLEL_REDO_WORKER_SYNC",
    "PARALLEL_REDO_WORKER_WAIT_WORK", "PREEMPTIVE_OS_FLUSHFILEBUFFERS",
    "PREEMPTIVE_XE_GETTARGETSTATE", "PVS_PREALLOCATE", "PWAIT_ALL_COMPONENTS_INITIALIZED",
    "PWAIT_DIRECTLOGCONSUMER_GETNEXT", "PWAIT_EXTENSIBILITY_CLEANUP_TASK",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP", "QDS_ASYNC_QUEUE",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_SHUTDOWN_QUEUE",
    "REDO_THREAD_PENDING_WORK", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE",
    "SERVER_IDLE_CHECK", "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP",
    "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY", "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP",
    "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP", "SNI_HTTP_ACCEPT",
    "SOS_WORK_DISPATCHER", "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_BUFFER_FLUSH",
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "SQLTRACE_WAIT_ENTRIES", "VDI_CLIENT_OTHER",
    "WAIT_FOR_RESULTS", "WAITFOR", "WAITFOR_TASKSHUTDOWN", "WAIT_XTP_RECOVERY",
    "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG", "WAIT_XTP_CKPT_CLOSE",
    "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
)

# Fixed value: prefix of the help link the Pareto report renders per wait type.
WAIT_HELP_URL = "https://www.sqlskills.com/help/waits/"

# Names, markers and statement formats the reports match or
# produce, kept as the source has them.
XE_SESSION = "system_health"
XE_TARGET = "ring_buffer"
DEADLOCK_EVENT_NAME = "xml_deadlock_report"
VICTIM_SEPARATOR = "\\r\\n"                      # the literal four characters \r\n
QUERY_DELTA_SELF_MARK = "--ThisRoutineIdentifier99"
COMBINED_DELTA_SELF_MARK = "--This routine identifier AMALGATEDDMV_snapshot"
WAITING_REPORT_SELF_MARK = "--ThisRoutimeIdentifier"
COMPANION_SELF_TEXT = "--This routine identifier"      # a whole text, not a prefix
WAIT_SLEEP_PATTERN = "%SLEEP"
COMBINED_SLEEP_PATTERN = "%SLEEP%"
WAITFOR_WAIT = "WAITFOR"
COMPILED_PLAN = "Compiled Plan"
PLAN_FEATURES = {
    "implicit_conversion": "CONVERT_IMPLICIT",
    "missing_index": "<MissingIndexes>",
    "missing_statistics": "<ColumnsWithNoStatistics>",
    "table_scan": "<TableScan",
}
DB_COUNTER_OBJECT_PATTERN = "%:Databases"
DB_SIZE_COUNTERS = ("Data File(s) Size (KB)", "Log File(s) Size (KB)", "Log File(s) Used Size (KB)")
MODULE_REWRITES = (("[RPS2017].", ""), ("[rps2017].", ""), ("CREATE VIEW", "ALTER VIEW"),
                   ("CREATE FUNCTION", "ALTER FUNCTION"), ("CREATE PROCEDURE", "ALTER PROCEDURE"))
MODULE_TYPES = ("V", "FN", "IF", "P", "TF")
DUPLICATE_INDEX_TYPES = ("NONCLUSTERED", "CLUSTERED")
LOCK_GRANTED = "GRANT"
LOCK_OBJECT = "OBJECT"
LOCK_ROW_KINDS = ("KEY", "PAGE", "RID")
ALTER_INDEX = "ALTER INDEX "
REBUILD_SUFFIX = " REBUILD WITH (ONLINE = OFF);"
REORGANIZE_SUFFIX = " REORGANIZE;"
STATS_REFRESH_PREFIX = "Update Statistics ["
STATS_REFRESH_SUFFIX = "] With FULLSCAN"
SYSTEM_STATS_PREFIX = "UPDATE STATISTICS "
CREATE_INDEX_PREFIX = "CREATE NONCLUSTERED INDEX "
INCLUDE_PREFIX = " INCLUDE ("
FILLFACTOR_CLAUSE = " WITH (FILLFACTOR = 90"
ONLINE_CLAUSE = ",ONLINE = ON"
