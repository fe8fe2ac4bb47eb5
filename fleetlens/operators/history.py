"""Deltas over a whole history of captures, cut where servers restarted (G06, G07 with R64).

A cumulative counter starts from zero when its server starts.  A value that is lower than before shows most restarts, but
not one after which the counter has already passed its old value; the recorded start times show them all.  Every capture
belongs to the *segment* of its server: the number of starts up to its time.  Inside a segment a counter gains the difference,
across segments it gains the value itself.

Server starts are few, so they travel as one small row per server (a sorted array of times), joined on the
server; the segment is then a function of the row, with no range join and no window over a server's captures.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .deltas import reset_delta
from .scope import times_of


def with_segments(captures: DataFrame, restarts: DataFrame | None, ts: str = "captured_at", per: str = "instance_id",
                  started: str = "server_start_time") -> DataFrame:
    """``captures`` with ``_segment``: how many starts of its server are known up to its time (0 without any)."""
    if restarts is None:
        return captures.withColumn("_segment", F.lit(0))
    starts = restarts.groupBy(F.col(per).alias("_server")).agg(F.array_sort(F.collect_set(F.col(started).cast(captures.schema[ts].dataType))).alias("_starts"))
    known = captures.join(starts, F.col(per) == F.col("_server"), "left")
    return known.withColumn("_segment", F.coalesce(F.size(F.filter("_starts", lambda s: s <= F.col(ts))), F.lit(0))).drop("_server", "_starts")


def with_previous(rows: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "captured_at", bucket: str = "1 day") -> DataFrame:
    """``rows`` with ``_prev``: the ``values`` and time (``ts``) of their key's row before (NULL for its first).

    ``lag`` runs inside (key, time bucket), so a key with a third of all rows is spread over its buckets; the first row of a bucket
    takes the last row of the key's nearest earlier bucket, from one row per key and bucket."""
    keys = list(keys)
    value = F.struct(F.col(ts).alias("at"), *[F.col(c) for c in values])
    rows = rows.withColumn("_now", value).withColumn("_bucket", F.window(F.col(ts), bucket).start)
    inside = rows.withColumn("_prev", F.lag("_now").over(Window.partitionBy(*keys, "_bucket").orderBy(ts)))
    last = rows.groupBy(*keys, "_bucket").agg(F.max("_now").alias("_last"))
    seeds = last.select(*[F.col(k).alias(f"_s_{k}") for k in keys + ["_bucket"]],
                        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_seed"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys + ["_bucket"]])
    out = inside.join(seeds, same, "left").withColumn("_prev", F.coalesce("_prev", "_seed"))
    return out.drop("_now", "_bucket", "_seed", *[f"_s_{k}" for k in keys + ["_bucket"]])


def counter_gains(captures: DataFrame, keys: Sequence[str], counters: Sequence[str], restarts: DataFrame | None = None,
                  ts: str = "captured_at", per: str = "instance_id", bucket: str = "1 day", on_reset: str = "current",
                  carry: Sequence[str] = ()) -> DataFrame:
    """What every counter gained from its key's capture before to each capture of a whole history.

    One row per key and capture: ``keys``, ``carry``, ``ts``, ``prev_<ts>`` and ``gain_<counter>``.  A key that other captures in between lack
    (it left the view and came back) gains from where it was last seen.  A key that appears after its server's first capture gains from
    zero; rows of a server's first capture have NULL gains, as nothing is known before.  Gains add up: those in
    (a, b] and (b, c] are those in (a, c], see :func:`gained_between`.  ``ts`` is unique within a key."""
    keys, counters = list(keys), list(counters)
    first = captures.groupBy(F.col(per).alias("_server")).agg(F.min(ts).alias("_first"))
    rows = with_segments(captures.select(*dict.fromkeys([*keys, *carry, *counters, ts, per])), restarts, ts, per)
    rows = with_previous(rows, keys, [*counters, "_segment"], ts, bucket).join(first, F.col(per) == F.col("_server"), "left")
    prev, new_segment = F.col("_prev"), F.col("_segment") != F.col("_prev._segment")

    def gain(c: str):
        unseen = F.when(F.col(ts) > F.col("_first"), F.col(c))
        return (F.when(prev.isNull(), unseen).when(new_segment, F.col(c))
                .otherwise(reset_delta(F.col(c), prev[c], on_reset)).alias(f"gain_{c}"))

    return rows.select(*dict.fromkeys([*keys, *carry]), ts, prev["at"].alias(f"prev_{ts}"), *[gain(c) for c in counters])


def gained_between(gains: DataFrame, keys: Sequence[str], counters: Sequence[str], start, end, ts: str = "captured_at") -> DataFrame:
    """The gains of the captures after ``start`` up to ``end``, per key; keys without a capture in between are left out."""
    low, high = times_of(gains, ts, [start, end])
    return gains.filter((F.col(ts) > low) & (F.col(ts) <= high)).groupBy(*keys).agg(*[F.sum(f"gain_{c}").alias(f"gain_{c}") for c in counters])


def segmented_delta(captures: DataFrame, keys: Sequence[str], counters: Sequence[str], start, end, restarts: DataFrame,
                    ts: str = "captured_at", keep: str | None = "changed", carry: Sequence[str] = (), per: str = "instance_id",
                    prefix: str = "delta_") -> DataFrame:
    """G06 between the captures ``start`` and ``end``, cut into segments at the servers' starts.

    A key's delta is the sum over the segments it was captured in: the last value of a segment, less the one at ``start`` in
    the segment that ``start`` belongs to.  Captures in between count, so what a counter held before a restart is not lost.
    Keys that the ``end`` capture lacks are dropped, as in the two-capture form; columns are those of ``capture_range_delta``."""
    keys, counters, carry = list(keys), list(counters), [c for c in carry if c not in keys]
    low, high = times_of(captures, ts, [start, end])
    rows = captures.filter((F.col(ts) >= low) & (F.col(ts) <= high))
    if "capture_date" in captures.columns:
        rows = rows.filter((F.col("capture_date") >= F.to_date(low)) & (F.col("capture_date") <= F.to_date(high)))
    rows = with_segments(rows, restarts, ts, per)
    values = F.struct(*[F.col(c) for c in dict.fromkeys(counters + carry)])
    segments = rows.groupBy(*keys, "_segment").agg(F.max(ts).alias("_at"), F.max_by(values, F.col(ts)).alias("_last"),
                                                   F.max(F.when(F.col(ts) == low, values)).alias("_start"))
    out = segments.groupBy(*keys).agg(
        F.max("_at").alias("_at"), F.max_by("_last", "_at").alias("_post"), F.max("_start").alias("_pre"),
        *[F.sum(F.col("_last")[c] - F.coalesce(F.col("_start")[c], F.lit(0))).alias(f"{prefix}{c}") for c in counters]).filter(F.col("_at") == high)
    out = out.select(*keys, *[F.col("_post")[c].alias(c) for c in carry], *[F.coalesce(F.col("_pre")[c], F.lit(0)).alias(f"pre_{c}") for c in counters],
                     *[F.col("_post")[c].alias(f"post_{c}") for c in counters], *[f"{prefix}{c}" for c in counters])
    if keep is None:
        return out
    kept = [F.col(f"{prefix}{c}") > 0 if keep == "positive" else F.col(f"{prefix}{c}") != 0 for c in counters]
    return out.filter(reduce(lambda a, b: a | b, kept))
