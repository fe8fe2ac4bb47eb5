"""G03 database scope and G22 optional substring filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def database_scope(df: DataFrame, col: str, database_id: int | None = None,
                   keep_adhoc: bool = True) -> DataFrame:
    """``db = DB_ID() OR db IS NULL``; ``database_id=None`` keeps every database.

    A plain column predicate, so Catalyst pushes it into the scan."""
    if database_id is None:
        return df
    cond = F.col(col) == F.lit(database_id)
    if keep_adhoc:
        cond = cond | F.col(col).isNull()
    return df.filter(cond)


def multi_filter(df: DataFrame, needles: dict[str, str | None]) -> DataFrame:
    """Case-insensitive substring filters; a ``None`` needle means "all" (G22)."""
    conds = [F.lower(F.col(c)).contains(v.lower()) for c, v in needles.items() if v is not None]
    if not conds:
        return df
    return df.filter(reduce(lambda a, b: a & b, conds))


def times_of(df: DataFrame, ts: str, at) -> list:
    """Capture times as literals of the column's own type."""
    return [F.lit(str(v)).cast(df.schema[ts].dataType) if not isinstance(v, F.Column) else v for v in at]


def captures_at(df: DataFrame, at: list, ts: str = "captured_at") -> DataFrame:
    """The rows of the captures taken at the times ``at``; a landed table's ``capture_date``
    partitions are pruned to their days."""
    times = times_of(df, ts, at)
    if "capture_date" in df.columns:
        df = df.filter(F.col("capture_date").isin(*[F.to_date(t) for t in times]))
    return df.filter(reduce(lambda a, b: a | b, [F.col(ts) == t for t in times]))


def capture_at(df: DataFrame, at, ts: str = "captured_at") -> DataFrame:
    """One capture of a table of many, without its time."""
    return captures_at(df, [at], ts).drop(ts, "capture_date")


def latest_capture(df: DataFrame, at=None, ts: str = "captured_at",
                   per: tuple[str, ...] = ("instance_id",), look_back_days: int | None = None) -> DataFrame:
    """Each instance's newest capture (at or before ``at`` when given).

    Servers are captured at their own times, so a fleet-wide point-in-time
    report takes every instance's latest capture: the newest time per
    instance is a small aggregate (one row per instance), joined back with a
    semi join on (instance, time).  ``look_back_days`` (with ``at``) leaves out servers not captured
    for so many days, and reads only those days' partitions; without it all history is looked at."""
    d = df
    if at is not None:
        when = times_of(df, ts, [at])[0]
        d = d.filter(F.col(ts) <= when)
        days = F.col("capture_date") if "capture_date" in df.columns else F.to_date(ts)
        if "capture_date" in df.columns:
            d = d.filter(days <= F.to_date(when))
        if look_back_days is not None:
            d = d.filter(days > F.date_sub(F.to_date(when), look_back_days))
    newest = d.groupBy(*per).agg(F.max(ts).alias(ts))
    return d.join(newest, list(per) + [ts], "left_semi")


def sample_keys(*facts: DataFrame) -> list[str]:
    """The keys that rows of one sample share: the instance and, where all the tables have it, the capture time."""
    return ["instance_id"] + (["captured_at"] if all("captured_at" in f.columns for f in facts) else [])
