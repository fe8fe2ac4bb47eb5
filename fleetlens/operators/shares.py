"""Shares of a total (G08), Pareto cut-off (G09) and conditional splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_of_total(df: DataFrame, value: str, per: Sequence[str] = ("instance_id",),
                   total_col: str = "_total") -> DataFrame:
    """Attach ``sum(value)`` over ``per`` to every row.

    Instead of ``sum() OVER ()`` (which moves every row to one partition) the
    totals are aggregated with map-side partial sums, one row per key, and
    joined back on the key.  With no ``per`` the total is a single row,
    broadcast to every task (the planner turns the constant key into a
    nested-loop join against that one row: linear in the input).
    """
    per = list(per)
    if not per:
        keyed = df.withColumn("_one", F.lit(1))
        tot = keyed.groupBy("_one").agg(F.sum(value).alias(total_col))
        return keyed.join(F.broadcast(tot), "_one").drop("_one")  # one row: a proven size bound
    tot = df.groupBy(*per).agg(F.sum(value).alias(total_col))
    return df.join(tot, per)


def pareto_cutoff(df: DataFrame, value: str, order: Sequence[Column], pct: int = 95,
                  per: Sequence[str] = ("instance_id",)) -> DataFrame:
    """Rows ranked by ``order`` until the share *before* the row reaches ``pct``.

    The row that crosses the line is kept.  The reference's triangular self
    join becomes a running ``sum`` window (``rowsBetween(unbounded, current)``)
    per instance, applied after aggregation so a window partition holds one
    row per wait type.  The comparison is exact in integers:
    ``(running - own) * 100 < pct * total``.
    """
    per = list(per)
    with_total = share_of_total(df, value, per, "_total")
    w = Window.partitionBy(*per).orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                              Window.currentRow)
    ranked = with_total.withColumn("_running", F.sum(value).over(w))
    before = (F.col("_running") - F.col(value)).cast("decimal(38,0)") * 100
    return ranked.filter(before < F.col("_total").cast("decimal(38,0)") * pct)


def conditional_split(df: DataFrame, predicate: Column, measures: Sequence[str],
                      keys: Sequence[str] = ()) -> DataFrame:
    """``SUM(CASE WHEN p ...)`` for both sides of a predicate plus totals."""
    aggs = []
    for m in measures:
        aggs += [F.sum(m).alias(f"total_{m}"),
                 F.sum(F.when(predicate, F.col(m)).otherwise(0)).alias(f"true_{m}"),
                 F.sum(F.when(~predicate, F.col(m)).otherwise(0)).alias(f"false_{m}")]
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(*aggs)
