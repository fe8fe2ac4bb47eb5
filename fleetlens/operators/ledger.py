"""Keep a usage ledger up to date from new captures.

Per key: rows only in the ledger stay as they are; a key's first capture seeds
it (previous = 0, diff = current, accumulated = current); every capture newer than
the ledger's current modification advances it, in order of capture time.  The
newer-than rule is on the capture's time, so several captures of one day, of one batch
or of servers captured at different moments are all applied.

One shuffle on the keys: the ledger's rows and the captures are put into one
ordered window per key, so any number of captures is folded in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _dealt(rows: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    return rows if parts is None else rows.repartition(parts, *keys)


def upsert_ledger(ledger: DataFrame | None, current: DataFrame, keys: Sequence[str],
                  counters: Sequence[str], carry: Sequence[str] = (),
                  modified: str = "captured_at", keep: dict | None = None, on_reset: str = "previous",
                  parts: int | None = None) -> DataFrame:
    """Return the new ledger.

    ``current``: one or more captures, each with one row per key: ``keys``, ``counters``,
    ``carry`` and the capture time ``modified`` (a row that is there twice counts once).
    Ledger columns per counter ``c``: ``current_c, last_c, diff_c, accumulated_c``; plus
    ``last_modification``, ``current_modification`` and the ``carry`` columns.
    ``ledger=None`` seeds it (the first run).  ``keep`` maps ledger-only
    bookkeeping columns to the Column their new rows start with; existing
    rows keep their values.  ``on_reset``: what a counter lower than before (the server
    restarted) adds: its ``'previous'`` value (the reference's rule) or its ``'current'`` one.
    With ``parts`` the rows are dealt out by ``keys`` to that many tasks.
    """
    keep = keep or {}
    keys, counters, carry = list(keys), list(counters), list(carry)
    current = _dealt(current, keys, parts)
    values = carry + counters
    rows = (current.groupBy(*keys, F.col(modified).alias("_at"))
            .agg(F.max(F.struct(*[F.col(c).cast("long").alias(c) if c in counters else F.col(c) for c in values])).alias("_v"))
            .withColumn("_l", F.lit(None)).withColumn("_new", F.lit(True)))
    if ledger is not None:
        base = ledger.select(*keys, F.col("current_modification").alias("_at"),
                             F.struct(*[F.col(c) for c in carry], *[F.col(f"current_{c}").alias(c) for c in counters]).alias("_v"),
                             F.struct(*[F.col(c) for c in ledger.columns]).alias("_l"), F.lit(False).alias("_new"))
        rows = _dealt(base.unionByName(rows.withColumn("_l", F.lit(None).cast(base.schema["_l"].dataType))), keys, parts)
        known = F.max(F.when(~F.col("_new"), F.col("_at"))).over(Window.partitionBy(*keys))
        rows = rows.withColumn("_known", known).filter(~F.col("_new") | F.col("_known").isNull() | (F.col("_at") > F.col("_known")))

    before = Window.partitionBy(*keys).orderBy("_at")
    rows = rows.withColumn("_p", F.lag("_v").over(before)).withColumn("_p_at", F.lag("_at").over(before))
    diffs = {}
    for c in counters:
        now, prev = F.col("_v")[c], F.col("_p")[c]
        restart = prev if on_reset == "previous" else now
        diffs[c] = F.when(prev.isNull(), now).when(now >= prev, now - prev).otherwise(restart)
    step = F.struct(F.col("_v").alias("v"), *[F.coalesce(F.col("_p")[c], F.lit(0).cast("long")).alias(f"last_{c}") for c in counters],
                    *[diffs[c].alias(f"diff_{c}") for c in counters], F.coalesce("_p_at", "_at").alias("last_at"), F.col("_at").alias("at"))
    g = rows.groupBy(*keys).agg(
        F.max_by(step, F.col("_at")).alias("s"), F.max(F.col("_new").cast("int")).alias("_changed"),
        *([F.first("_l", ignorenulls=True).alias("l")] if ledger is not None else []),
        *[F.sum(F.when(F.col("_new"), diffs[c])).alias(f"_add_{c}") for c in counters])

    changed = F.col("_changed") == 1
    old = (lambda c: F.col(f"l.{c}")) if ledger is not None else (lambda c: F.lit(None))
    pick = lambda new, c: F.when(changed, new).otherwise(old(c)).alias(c)
    out = [pick(F.col(f"s.v.{c}"), c) for c in carry]
    for c in counters:
        out += [pick(F.col(f"s.v.{c}"), f"current_{c}"), pick(F.col(f"s.last_{c}"), f"last_{c}"), pick(F.col(f"s.diff_{c}"), f"diff_{c}"),
                pick(F.coalesce(old(f"accumulated_{c}"), F.lit(0).cast("long")) + F.col(f"_add_{c}"), f"accumulated_{c}")]
    out += [pick(F.col("s.last_at"), "last_modification"), pick(F.col("s.at"), "current_modification")]
    out += [(v if ledger is None else F.when(F.col("l").isNull(), v).otherwise(F.col(f"l.{k}"))).alias(k) for k, v in keep.items()]
    return g.select(*keys, *out)


def upsert_intervals(intervals: DataFrame | None, current: DataFrame, keys: Sequence[str], counters: Sequence[str],
                     carry: Sequence[str] = (), modified: str = "captured_at", on_reset: str = "previous",
                     parts: int | None = None) -> DataFrame:
    """The usage ledger kept as intervals, for captures that arrive in any order.

    One row per key and capture: what the counters gained since the key's capture before (``from_at``, NULL for the
    first) up to this one (``at``).  A capture that arrives late falls into an interval and splits it; one that is there already
    changes nothing.  So the result only depends on the captures, not on when or how often they came.
    Columns: ``keys``, ``from_at``, ``at``, ``carry``, and per counter ``current_c``, ``last_c`` (0 for the first) and ``gain_c``.
    With ``parts`` the rows are dealt out by ``keys`` to that many tasks."""
    keys, counters, carry = list(keys), list(counters), list(carry)
    current = _dealt(current, keys, parts)
    value = F.struct(*[F.col(c) for c in carry], *[F.col(c).cast("long").alias(c) for c in counters])
    points = current.groupBy(*keys, F.col(modified).alias("at")).agg(F.max(value).alias("_v")).withColumn("_new", F.lit(1))
    if intervals is not None:
        known = F.struct(*[F.col(c) for c in carry], *[F.col(f"current_{c}").alias(c) for c in counters])
        points = _dealt(points.unionByName(intervals.select(*keys, "at", known.alias("_v"), F.lit(0).alias("_new"))), keys, parts)
        points = points.groupBy(*keys, "at").agg(F.min_by("_v", "_new").alias("_v"))
    before = Window.partitionBy(*keys).orderBy("at")
    rows = points.withColumns({"from_at": F.lag("at").over(before), "_p": F.lag("_v").over(before)})
    out = [F.col("_v")[c].alias(c) for c in carry]
    for c in counters:
        now, prev = F.col("_v")[c], F.col("_p")[c]
        restart = prev if on_reset == "previous" else now
        out += [now.alias(f"current_{c}"), F.coalesce(prev, F.lit(0).cast("long")).alias(f"last_{c}"),
                F.when(prev.isNull(), now).when(now >= prev, now - prev).otherwise(restart).alias(f"gain_{c}")]
    return rows.select(*keys, "from_at", "at", *out)


def ledger_of_intervals(intervals: DataFrame, keys: Sequence[str], counters: Sequence[str], carry: Sequence[str] = (),
                        keep: dict | None = None) -> DataFrame:
    """The ledger (the columns of :func:`upsert_ledger`) that intervals add up to."""
    keys, counters, carry = list(keys), list(counters), list(carry)
    last = F.struct(*[F.col(c) for c in intervals.columns if c not in keys])
    g = intervals.groupBy(*keys).agg(F.max_by(last, F.col("at")).alias("s"), *[F.sum(f"gain_{c}").alias(f"accumulated_{c}") for c in counters])
    out = [F.col("s")[c].alias(c) for c in carry]
    for c in counters:
        out += [F.col("s")[f"current_{c}"].alias(f"current_{c}"), F.col("s")[f"last_{c}"].alias(f"last_{c}"),
                F.col("s")[f"gain_{c}"].alias(f"diff_{c}"), F.col(f"accumulated_{c}")]
    out += [F.coalesce("s.from_at", "s.at").alias("last_modification"), F.col("s.at").alias("current_modification")]
    return g.select(*keys, *out, *[v.alias(k) for k, v in (keep or {}).items()])
