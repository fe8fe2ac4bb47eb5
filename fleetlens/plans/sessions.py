"""Sessions, blocking, locks and temp-space reports over one sample of the
session views (R58, R59, R65-R71).

Session ids only mean something inside one instance and one sample: the session views are joined on
the instance and, where they hold several captures, the capture time; names, texts and plans on
the instance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact_ratio, int_div, statement_slice
from ..operators import blocking_pairs, database_scope, resolve_handle, resolve_plan, sample_keys, shuffled
from .constants import LOCK_GRANTED, LOCK_OBJECT, LOCK_ROW_KINDS

C = ["instance_id"]   # keys of catalogs, texts and plans


def _mb3(c) -> F.Column:
    """pages * (8.0 / 1024.0) as DECIMAL(20,3)."""
    return exact_ratio(c, F.lit(128), scale=3, precision=20)


def _space_base(space, sessions, connections, texts):
    I = sample_keys(space, sessions, connections)
    s = sessions.select(*I, "session_id", "login_name", "host_name", "program_name")
    c = connections.select(*I, F.col("most_recent_session_id").alias("session_id"), "connection_id",
                           "most_recent_sql_handle", "last_read", "last_write")
    t = texts.select(*C, F.col("sql_handle").alias("most_recent_sql_handle"), F.col("text").alias("last_query"))
    j = space.filter(F.col("session_id") > 50).join(s, I + ["session_id"]).join(c, I + ["session_id"], "left")
    return resolve_handle(j, t, C + ["most_recent_sql_handle"], "left")


def temp_space_by_session_detail(space, sessions, connections, texts) -> DataFrame:
    """R58 (first result): per session row with its last statement text."""
    I = sample_keys(space, sessions, connections)
    j = _space_base(space, sessions, connections, texts)
    return j.select(*I, "session_id", "connection_id", "login_name", "host_name", "last_query", "last_read",
                    "last_write", "program_name", "user_objects_alloc_page_count", "user_objects_dealloc_page_count",
                    "internal_objects_alloc_page_count", "internal_objects_dealloc_page_count")


def _used():
    return F.col("user_objects_alloc_page_count") + F.col("internal_objects_alloc_page_count")


def _still():
    return (F.col("user_objects_alloc_page_count") - F.col("user_objects_dealloc_page_count")
            + F.col("internal_objects_alloc_page_count") - F.col("internal_objects_dealloc_page_count"))

_GROUP = ["session_id", "connection_id", "login_name", "host_name", "most_recent_sql_handle", "last_read",
          "last_write", "program_name"]


def temp_space_by_session(space, sessions, connections, texts) -> DataFrame:
    """Temp space used and still used (MB) per session.

    Grouped on the keys; the text (a function of the handle) is attached
    after the aggregation instead of being a group key."""
    I = sample_keys(space, sessions, connections)
    s = sessions.select(*I, "session_id", "login_name", "host_name", "program_name")
    c = connections.select(*I, F.col("most_recent_session_id").alias("session_id"), "connection_id",
                           "most_recent_sql_handle", "last_read", "last_write")
    j = space.filter(F.col("session_id") > 50).join(s, I + ["session_id"]).join(c, I + ["session_id"], "left")
    g = j.groupBy(*I, *_GROUP).agg(F.sum(_used()).alias("_u"), F.sum(_still()).alias("_s"))
    t = texts.select(*C, F.col("sql_handle").alias("most_recent_sql_handle"), F.col("text").alias("last_query"))
    g = resolve_handle(g, t, C + ["most_recent_sql_handle"], "left")
    return g.select(*I, _mb3("_u").alias("space_used_mb"), _mb3("_s").alias("space_still_used_mb"),
                    "session_id", "connection_id", "login_name", "host_name", "last_query", "last_read",
                    "last_write", "program_name")


def temp_space_by_task_detail(task_space, sessions, connections, texts) -> DataFrame:
    """R59 (first result): per task row with its session's last statement text."""
    return temp_space_by_session_detail(task_space, sessions, connections, texts)


def temp_space_by_task(task_space, sessions, connections, texts, requests) -> DataFrame:
    """As R58 over task space, with the running statement in the group."""
    I = sample_keys(task_space, sessions, connections, requests)
    s = sessions.select(*I, "session_id", "login_name", "host_name", "program_name")
    c = connections.select(*I, F.col("most_recent_session_id").alias("session_id"), "connection_id",
                           "most_recent_sql_handle", "last_read", "last_write")
    r = requests.select(*I, "session_id", "statement_start_offset", "statement_end_offset")
    j = task_space.filter(F.col("session_id") > 50).join(s, I + ["session_id"]).join(c, I + ["session_id"], "left")
    j = j.join(r, I + ["session_id"], "left")
    g = j.groupBy(*I, *_GROUP, "statement_start_offset", "statement_end_offset").agg(
        F.sum(_used()).alias("_u"), F.sum(_still()).alias("_s"))
    t = texts.select(*C, F.col("sql_handle").alias("most_recent_sql_handle"), F.col("text").alias("last_query"))
    g = resolve_handle(g, t, C + ["most_recent_sql_handle"], "left")
    return g.select(*I, _mb3("_u").alias("space_used_mb"), _mb3("_s").alias("space_still_used_mb"),
                    "session_id", "connection_id", "login_name", "host_name", "last_query",
                    statement_slice("last_query", "statement_start_offset", "statement_end_offset").alias("sql_text"),
                    "last_read", "last_write", "program_name")


def running_requests(requests, sessions, texts, plans, databases, exclude_session=None,
                     database_id=None) -> DataFrame:
    """User requests with statement, resources, wait and blocker."""
    I = sample_keys(requests, sessions)
    s = sessions.filter(F.col("is_user_process")).select(*I, "session_id", "host_name", "login_name", "program_name")
    if exclude_session is not None:
        s = s.filter(F.col("session_id") != exclude_session)
    t = texts.select(*C, "sql_handle", F.col("text").alias("parent_query"))
    p = plans.select(*C, "plan_handle", "dbid")
    j = database_scope(requests.join(s, I + ["session_id"]).join(p, C + ["plan_handle"]), "dbid", database_id)
    d = databases.select(*C, F.col("database_id").alias("dbid"), F.col("name").alias("database_name"))
    j = resolve_handle(j.join(d, C + ["dbid"], "left"), t, C + ["sql_handle"])
    j = resolve_plan(j, plans)   # wide column last
    return j.select(*I, "session_id", "host_name", "login_name", "status", "database_name",
                    statement_slice("parent_query", "statement_start_offset", "statement_end_offset").alias("sql_text"),
                    "parent_query", "program_name", "start_time", "query_plan", "wait_type", "total_elapsed_time",
                    "cpu_time", "logical_reads", "blocking_session_id", "open_transaction_count", "last_wait_type",
                    "percent_complete")


def _both_texts(pairs: DataFrame, texts: DataFrame, blocked: str) -> DataFrame:
    """The blocking and the blocked session's text of each pair, attached last."""
    t1 = texts.select(*C, F.col("sql_handle").alias("most_recent_sql_handle"), F.col("text").alias("blocking_sql"))
    t2 = texts.select(*C, "sql_handle", F.col("text").alias(blocked))
    return resolve_handle(resolve_handle(pairs, t1, C + ["most_recent_sql_handle"]), t2, C + ["sql_handle"])


def blocking_now(connections, requests, waits, sessions, texts, databases, database_id=None) -> DataFrame:
    """Blocker and blocked with both texts and the wait reason."""
    I = sample_keys(connections, requests, waits, sessions)
    blocking = connections.select(*I, "session_id", "most_recent_sql_handle")
    blocked = requests.select(*I, F.col("session_id").alias("blocked_session_id"), "blocking_session_id",
                              "sql_handle", "database_id", "user_id")
    pairs = blocking_pairs(blocked, blocking, keys=I)
    w = waits.select(*I, F.col("session_id").alias("blocked_session_id"), F.col("wait_type").alias("why_blocked"))
    sess = sessions.select(*I, F.col("session_id").alias("blocking_session_id"), F.col("login_name").alias("blocking_user"))
    j = pairs.join(w, I + ["blocked_session_id"]).join(sess, I + ["blocking_session_id"])
    if database_id is not None:
        j = j.filter(F.col("database_id") == database_id)
    d = databases.select(*C, "database_id", F.col("name").alias("database_name"))
    j = _both_texts(j.join(d, C + ["database_id"], "left"), texts, "blocked_sql")
    return j.select(*I, "blocking_session_id", "blocking_user", "blocking_sql", "why_blocked", "blocked_session_id",
                    F.col("user_id").alias("blocked_user_id"), "blocked_sql", "database_name")


def blocked_sessions(connections, requests, waits, sessions, transactions, texts, databases,
                     min_wait_ms: int | None = None, with_statement: bool = True) -> DataFrame:
    """Wait seconds, who blocks whom and from where; with
    ``min_wait_ms`` only waits longer than that (R68 drops the statement)."""
    I = sample_keys(connections, requests, waits, sessions, transactions)
    blocking = connections.select(*I, "session_id", "most_recent_sql_handle")
    blocked = requests.select(*I, F.col("session_id").alias("blocked_session_id"), "blocking_session_id",
                              "sql_handle", "database_id", "statement_start_offset", "statement_end_offset")
    pairs = blocking_pairs(blocked, blocking, keys=I)
    tx = transactions.select(*I, F.col("session_id").alias("blocking_session_id"))
    sess = sessions.select(*I, F.col("session_id").alias("blocking_session_id"),
                           F.col("login_name").alias("blocking_user"), F.col("host_name").alias("blocking_location"))
    bsess = sessions.select(*I, F.col("session_id").alias("blocked_session_id"),
                            F.col("login_name").alias("blocked_user"), F.col("host_name").alias("blocked_location"))
    w = waits.select(*I, F.col("session_id").alias("blocked_session_id"), "wait_duration_ms", "wait_type")
    if min_wait_ms is not None:
        w = w.filter(F.col("wait_duration_ms") > min_wait_ms)
    j = pairs.join(sess, I + ["blocking_session_id"]).join(tx, I + ["blocking_session_id"], "left_semi")
    j = j.join(w, I + ["blocked_session_id"]).join(bsess, I + ["blocked_session_id"])
    d = databases.select(*C, "database_id", F.col("name").alias("database_name"))
    j = _both_texts(j.join(d, C + ["database_id"], "left"), texts, "_blocked_text")
    cols = [int_div("wait_duration_ms", 1000).alias("wait_in_seconds"), "blocking_session_id", "database_name",
            "blocking_user", "blocking_location", "blocking_sql", "blocked_session_id", "blocked_user",
            "blocked_location"]
    if with_statement:
        cols.append(statement_slice("_blocked_text", "statement_start_offset", "statement_end_offset")
                    .alias("blocked_individual_query"))
    return j.select(*I, *cols, "wait_type")


def _resource_names(locks, objects, partitions) -> DataFrame:
    """Object name of each lock: OBJECT -> the object; KEY / PAGE / RID -> the
    object of the partition whose hobt id it names.

    The source's correlated scalar subqueries become one lookup table of
    ``(kind, entity id) -> name`` (objects by id, plus partitions joined to
    their objects by hobt id; both catalog-sized) and a single left join.
    Neither catalog is broadcast: the objects of a whole fleet don't fit a driver."""
    o = objects.select(*C, F.col("database_id").alias("resource_database_id"), "object_id", "name")
    by_object = o.select(*C, "resource_database_id", F.lit(LOCK_OBJECT).alias("_kind"),
                         F.col("object_id").cast("long").alias("_entity"), F.col("name").alias("resource_type_name"))
    p = partitions.select(*C, F.col("database_id").alias("resource_database_id"), "object_id",
                          F.col("partition_id").cast("long").alias("_entity"))
    by_hobt = p.join(shuffled(o), C + ["resource_database_id", "object_id"]).select(
        *C, "resource_database_id", F.lit("ROW").alias("_kind"), "_entity", F.col("name").alias("resource_type_name"))
    lookup = by_object.unionByName(by_hobt)
    kind = (F.when(F.col("resource_type") == LOCK_OBJECT, F.lit(LOCK_OBJECT))
            .when(F.col("resource_type").isin(*LOCK_ROW_KINDS), F.lit("ROW")))
    l = locks.withColumn("_kind", kind).withColumn("_entity", F.col("resource_associated_entity_id").cast("long"))
    return l.join(shuffled(lookup), C + ["resource_database_id", "_kind", "_entity"], "left").drop("_kind", "_entity")


def locks_held(locks, objects, partitions, databases, exclude_session=None) -> DataFrame:
    """Locks with the locked object's name resolved by resource type."""
    I = sample_keys(locks)
    l = locks if exclude_session is None else locks.filter(F.col("request_session_id") != exclude_session)
    l = _resource_names(l, objects, partitions)
    d = databases.select(*C, F.col("database_id").alias("resource_database_id"), F.col("name").alias("database_name"))
    l = l.join(d, C + ["resource_database_id"], "left")
    return l.select(*I, "database_name", "request_session_id", "resource_type", "resource_type_name",
                    "request_status", "request_mode")


def contended_resources(locks, objects, partitions, databases, connections, texts, requests) -> DataFrame:
    """Locks on a resource that another lock holds or waits for with a
    different status, with the requesting session's statement.

    The source's self join emits one row per (lock, other lock) pair; here
    each lock appears once with ``contending_locks``, the number of such
    other locks, computed from per-resource counts (no pairs are formed, so
    a hot resource with many waiters stays linear).  The resource is compared
    (the source compares a column with itself).  Who contends is named by the resource's smallest
    holding and smallest waiting session.

    All its tables grow with the fleet, so none is broadcast (the driver would hold them side by side).  Names are found once per
    contended resource and status, and a connection's request before the locks meet it, so a lock row is dealt out
    by its resource, its session and its text only."""
    I = sample_keys(locks, connections, requests)
    key = I + ["resource_database_id", "resource_type", "resource_associated_entity_id", "_desc"]
    l = locks.withColumn("_desc", F.coalesce(F.col("resource_description"), F.lit("\u0000null")))
    # one partial aggregation per (resource, status); the per-resource total is a
    # window over those few rows (a resource has a handful of statuses)
    per_status = l.groupBy(*key, "request_status").agg(F.count("*").alias("_ns"), F.min("request_session_id").alias("_first"))
    resource, granted = Window.partitionBy(*key), F.col("request_status") == LOCK_GRANTED
    per_status = per_status.withColumns({"_n": F.sum("_ns").over(resource), "holder_session_id": F.min(F.when(granted, F.col("_first"))).over(resource),
                                         "waiter_session_id": F.min(F.when(~granted, F.col("_first"))).over(resource)}).drop("_first")
    per_status = per_status.filter(F.col("_n") > F.col("_ns")).withColumn("contending_locks", F.col("_n") - F.col("_ns")).drop("_n", "_ns")
    d = databases.select(*C, F.col("database_id").alias("resource_database_id"), F.col("name").alias("database_name"))
    named = _resource_names(per_status, objects, partitions).join(shuffled(d), C + ["resource_database_id"], "left")
    l = l.join(shuffled(named), key + ["request_status"])
    c = connections.select(*I, F.col("most_recent_session_id").alias("request_session_id"), "connection_id",
                           "most_recent_sql_handle")
    t = texts.select(*C, F.col("sql_handle").alias("most_recent_sql_handle"), F.col("text").alias("parent_query"))
    r = requests.select(*I, "connection_id", "statement_start_offset", "statement_end_offset")
    j = l.join(shuffled(c.join(shuffled(r), I + ["connection_id"], "left")), I + ["request_session_id"])
    # text last; its handles are those of the connections, which costs less than to find the locks a second time
    j = resolve_handle(j, shuffled(t), C + ["most_recent_sql_handle"], needed=c.filter(F.col("request_session_id").isNotNull()))
    return j.select(*I, "resource_type", "database_name", "resource_associated_entity_id", "request_session_id",
                    "request_mode", "request_status", "resource_type_name", "parent_query",
                    statement_slice("parent_query", "statement_start_offset", "statement_end_offset").alias("sql_text"),
                    "contending_locks", "holder_session_id", "waiter_session_id")


def idle_open_transactions(sessions, transactions, connections, texts, requests) -> DataFrame:
    """Sessions holding an open transaction with no running request
    (the source's NULL test in the ON clause filters nothing; a left anti
    join does what it means)."""
    I = sample_keys(sessions, transactions, connections, requests)
    s = sessions.select(*I, "session_id", "login_name", "host_name", "program_name")
    tx = transactions.select(*I, "session_id")
    c = connections.select(*I, "session_id", "most_recent_sql_handle", "last_read", "last_write")
    t = texts.select(*C, F.col("sql_handle").alias("most_recent_sql_handle"), "text")
    j = s.join(tx, I + ["session_id"]).join(c, I + ["session_id"])
    j = j.join(requests.select(*I, "session_id"), I + ["session_id"], "left_anti")
    j = resolve_handle(j, t, C + ["most_recent_sql_handle"])
    return j.select(*I, "session_id", "login_name", "host_name", "text", "last_read", "last_write", "program_name")


def blocked_longer_than(connections, requests, waits, sessions, transactions, texts, databases,
                        seconds: int = 30) -> DataFrame:
    """R67 for waits longer than ``seconds`` (the source leaves the statement out)."""
    return blocked_sessions(connections, requests, waits, sessions, transactions, texts, databases,
                            min_wait_ms=seconds * 1000, with_statement=False)
