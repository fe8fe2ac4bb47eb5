"""Deadlock reports over extended-event ring buffers.

A ring buffer document is bounded (a few MB per instance and capture), so
one task parses one document; nothing is gathered across documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import statement_slice
from ..functions.xml import parse_xml, xml_rows
from ..operators import resolve_handle
from .constants import DEADLOCK_EVENT_NAME, VICTIM_SEPARATOR, XE_SESSION, XE_TARGET

# What a buffer is made of, from its start on: comments, CDATA sections and instructions, which may hold anything, and event elements
# (with or without a prefix): the tag with attributes in any order and quoting, then text, CDATA, comments and other
# markup up to its end tag; possessive, so that a long buffer is read once
_OTHER = r"""<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>"""
EVENT = (_OTHER + r"""|<((?:[\w.-]++:)?)event(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:(?<=/)>|(?<!/)>"""
         r"""(?:[^<]++|<!\[CDATA\[[\s\S]*?\]\]>|<!--[\s\S]*?-->|<(?!/\1event\s*>))*+</\1event\s*>)""")
VICTIM_SEP = VICTIM_SEPARATOR

EVENT_SCHEMA = (
    "_name STRING, _timestamp STRING, data STRUCT<value: STRUCT<deadlock: STRUCT<"
    "`victim-list`: STRUCT<victimProcess: ARRAY<STRUCT<_id: STRING>>>, "
    "`process-list`: STRUCT<process: ARRAY<STRUCT<_id: STRING, executionStack: STRUCT<"
    "frame: ARRAY<STRUCT<_sqlhandle: STRING, _stmtstart: STRING, _stmtend: STRING>>>>>>>>>")


def _health_targets(targets: DataFrame) -> DataFrame:
    return targets.filter((F.col("session_name") == XE_SESSION) & (F.col("target_name") == XE_TARGET))


def event_time(text) -> F.Column:
    """Wall-clock UTC time of an event's ``timestamp``: with or without fractions, ``Z`` or an
    offset; NULL when it can't be read."""
    parts = r"^(.*?)(?:Z|([+-])(\d\d):?(\d\d))?$"
    base = F.replace(F.regexp_extract(text, parts, 1), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    sign = F.when(F.regexp_extract(text, parts, 2) == "-", -1).otherwise(1)
    hours, minutes = (F.coalesce(F.nullif(F.regexp_extract(text, parts, k), F.lit("")).try_cast("int"), F.lit(0)) for k in (3, 4))
    return base - F.make_dt_interval(hours=sign * hours, mins=sign * minutes)


def deadlock_events(targets: DataFrame) -> DataFrame:
    """One row per deadlock report: its time and its event XML.

    The buffer is read in order, part by part, so an event that stands in a comment between two events is none; events keep their
    own text whatever the order of their attributes or the markup inside them.  Name and time are read from the parsed event."""
    parts = F.regexp_extract_all("target_data", F.lit(EVENT), F.lit(0))
    events = F.filter(parts, lambda p: ~p.startswith("<!") & ~p.startswith("<?"))
    ev = _health_targets(targets).select("instance_id", F.explode(events).alias("ev"))
    ev = ev.withColumn("_e", parse_xml(F.col("ev"), "_name STRING, _timestamp STRING"))
    return ev.filter(F.col("_e._name") == DEADLOCK_EVENT_NAME).select(
        "instance_id", event_time(F.col("_e._timestamp")).alias("creation_date"), F.col("ev").alias("extend_event"))


def deadlock_processes(targets: DataFrame, texts: DataFrame) -> DataFrame:
    """Per deadlock process: victims, first frame's handle and offsets,
    batch text (outer lookup) and statement slice.  Events without processes
    keep one row (OUTER APPLY)."""
    ev = deadlock_events(targets)
    e = xml_rows(ev, "extend_event", EVENT_SCHEMA, ["data", "value", "deadlock", "process-list", "process"],
                 alias="p", outer=True, doc_alias="_doc")
    victims = F.transform(F.col("_doc.data.value.deadlock.victim-list.victimProcess"), lambda v: v["_id"])
    e = e.withColumn("victim_ids", F.array_join(victims, VICTIM_SEP))
    frame = F.col("p.executionStack.frame").getItem(0)
    e = e.select("instance_id", "creation_date", "victim_ids", F.col("p._id").alias("process_id"),
                 frame["_sqlhandle"].alias("handle"), frame["_stmtstart"].try_cast("int").alias("stmtstart"),
                 frame["_stmtend"].try_cast("int").alias("stmtend"))
    t = texts.select("instance_id", F.col("sql_handle").alias("handle"), F.col("text").alias("parent_sql_text"))
    e = resolve_handle(e, t, ["instance_id", "handle"], "left")
    return e.select("instance_id", "creation_date", "victim_ids", "process_id", "parent_sql_text",
                    statement_slice("parent_sql_text", "stmtstart", "stmtend").alias("sql_text"),
                    "handle", "stmtstart", "stmtend")


def deadlock_counts(targets: DataFrame) -> DataFrame:
    """Events held by each ring buffer and how many are deadlock reports
    (one parse per document, only the event names are materialised)."""
    doc = parse_xml(F.col("target_data"), "_eventCount INT, event ARRAY<STRUCT<_name: STRING>>")
    t = _health_targets(targets).select("instance_id", doc.alias("d"))
    return t.select("instance_id", F.col("d._eventCount").alias("ring_buffer_event_count"),
                    F.size(F.filter("d.event", lambda e: e["_name"] == DEADLOCK_EVENT_NAME)).alias("event_deadlock"))
