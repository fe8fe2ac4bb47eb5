"""Deltas of cumulative counters between captures (G06) and along a sample
series (G07)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scope import captures_at


def reset_delta(cur: Column, prev: Column, on_reset: str) -> Column:
    prev0 = F.coalesce(prev, F.lit(0))
    raw = cur - prev0
    if on_reset == "raw":
        return raw
    if on_reset == "current":      # counter restarted: everything since is new
        return F.when(cur < prev0, cur).otherwise(raw)
    if on_reset == "previous":     # the ledger's rule
        return F.when(cur < prev0, prev0).otherwise(raw)
    raise ValueError(on_reset)


def snapshot_delta(pre: DataFrame, post: DataFrame, keys: Sequence[str],
                   counters: Sequence[str], keep: str | None = "changed",
                   on_reset: str = "current", carry: Sequence[str] = (),
                   prefix: str = "delta_") -> DataFrame:
    """Delta of cumulative counters between two captures.

    ``pre RIGHT JOIN post`` written as ``post LEFT JOIN pre`` on null-safe key
    equality (so a NULL key pairs only with NULL; Catalyst still plans it as an
    equi join).  A key missing from ``pre`` counts from 0.  ``keep='changed'``
    keeps rows where any delta is non-zero, ``'positive'`` where any is > 0,
    ``None`` keeps all.  ``carry`` columns are taken from ``post``.
    ``on_reset``: a counter lower than before means a restart; ``'current'``
    takes the value since the restart, ``'previous'`` the ledger's rule,
    ``'raw'`` the plain (negative) difference the statement delta reports.
    """
    keys, counters = list(keys), list(counters)
    p = pre.select(*[F.col(k).alias(f"_pre_{k}") for k in keys],
                   *[F.col(c).alias(f"_pre_{c}") for c in counters])
    cond = [F.col(k).eqNullSafe(F.col(f"_pre_{k}")) for k in keys]
    j = post.select(*keys, *counters, *[c for c in carry if c not in keys + counters]).join(
        p, reduce(lambda a, b: a & b, cond), "left")
    out = j.select(*keys, *[c for c in carry if c not in keys + counters],
                   *[F.coalesce(F.col(f"_pre_{c}"), F.lit(0)).alias(f"pre_{c}") for c in counters],
                   *[F.col(c).alias(f"post_{c}") for c in counters],
                   *[reset_delta(F.col(c), F.col(f"_pre_{c}"), on_reset).alias(f"{prefix}{c}")
                     for c in counters])
    if keep == "changed":
        out = out.filter(reduce(lambda a, b: a | b, [F.col(f"{prefix}{c}") != 0 for c in counters]))
    elif keep == "positive":
        out = out.filter(reduce(lambda a, b: a | b, [F.col(f"{prefix}{c}") > 0 for c in counters]))
    return out


def consecutive_delta(samples: DataFrame, keys: Sequence[str], counter: str,
                      ts: str = "captured_at", bucket: str = "1 hour",
                      on_reset: str = "raw") -> DataFrame:
    """Previous sample and change per key along a sample series.

    A plain ``lag`` over ``partitionBy(keys)`` puts a whole series in one task,
    and one series may hold a third of all rows.  So the series is cut into
    time buckets: ``lag`` runs inside ``(keys, bucket)`` partitions, and the
    first sample of each bucket takes the last sample of the nearest earlier
    non-empty bucket from a small per-bucket table (one row per key and
    bucket) with its own ``lag``.  The result equals a single ``lag`` over the
    whole series.  Ties in ``ts`` must not occur within a key.
    """
    keys = list(keys)
    b = samples.withColumn("_bucket", F.window(F.col(ts), bucket).start)
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    inner = b.withColumn("_prev_in", F.lag(counter).over(w)).withColumn(
        "_prev_ts_in", F.lag(ts).over(w))
    last = b.groupBy(*keys, "_bucket").agg(
        F.max_by(F.col(counter), F.col(ts)).alias("_last_val"), F.max(ts).alias("_last_ts"))
    wb = Window.partitionBy(*keys).orderBy("_bucket")
    seed = last.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_bucket").alias("_s__bucket"),
                       F.lag("_last_val").over(wb).alias("_seed_val"),
                       F.lag("_last_ts").over(wb).alias("_seed_ts"))
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys + ["_bucket"]])
    j = inner.join(seed, cond, "left").drop(*[f"_s_{k}" for k in keys + ["_bucket"]])
    first = F.col("_prev_ts_in").isNull()
    prev = F.when(first, F.col("_seed_val")).otherwise(F.col("_prev_in"))
    prev_ts = F.when(first, F.col("_seed_ts")).otherwise(F.col("_prev_ts_in"))
    out = j.withColumn("prev_value", prev).withColumn("prev_" + ts, prev_ts)
    delta = F.when(F.col("prev_value").isNull(), F.lit(None)).otherwise(
        reset_delta(F.col(counter), F.col("prev_value"), on_reset))
    return out.withColumn("delta_value", delta).drop(
        "_bucket", "_prev_in", "_prev_ts_in", "_seed_val", "_seed_ts")


def capture_range_delta(captures: DataFrame, keys: Sequence[str], counters: Sequence[str], start, end,
                        ts: str = "captured_at", keep: str | None = "changed", on_reset: str = "current",
                        carry: Sequence[str] = (), prefix: str = "delta_") -> DataFrame:
    """G06 in one pass over a table holding many captures.

    Instead of joining two filtered copies of the table, the rows of the
    captures ``start`` .. ``end`` are grouped by key once (partial
    aggregation, one shuffle): the row of the first and of the last capture
    of each key are picked with ``min_by`` / ``max_by``.  A key missing from
    the ``start`` capture counts from 0; a key missing from the ``end``
    capture is dropped (the right join of the two-capture form).  Grouping
    treats NULL keys as equal, like the null-safe join."""
    keys, counters, carry = list(keys), list(counters), [c for c in carry if c not in keys]
    # capture times as literals of the column's own type (wall-clock strings are exact for both kinds)
    rng = captures_at(captures, [start, end], ts)
    ts_type = captures.schema[ts].dataType
    start, end = (F.lit(str(v)).cast(ts_type) if not isinstance(v, F.Column) else v for v in (start, end))
    vals = F.struct(*[F.col(c) for c in counters + carry])
    g = rng.groupBy(*keys).agg(F.min(ts).alias("_first_ts"), F.max(ts).alias("_last_ts"),
                               F.min_by(vals, F.col(ts)).alias("_first"), F.max_by(vals, F.col(ts)).alias("_last"))
    g = g.filter(F.col("_last_ts") == end)
    at_start = F.col("_first_ts") == start
    out = g.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in carry],
                   *[F.when(at_start, F.col(f"_first.{c}")).otherwise(F.lit(0)).alias(f"pre_{c}") for c in counters],
                   *[F.col(f"_last.{c}").alias(f"post_{c}") for c in counters],
                   *[reset_delta(F.col(f"_last.{c}"), F.when(at_start, F.col(f"_first.{c}")), on_reset)
                     .alias(f"{prefix}{c}") for c in counters])
    if keep == "changed":
        out = out.filter(reduce(lambda a, b: a | b, [F.col(f"{prefix}{c}") != 0 for c in counters]))
    elif keep == "positive":
        out = out.filter(reduce(lambda a, b: a | b, [F.col(f"{prefix}{c}") > 0 for c in counters]))
    return out
