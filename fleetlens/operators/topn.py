"""``ORDER BY ... TOP (n)``, optionally top-n per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, order: Sequence[Column], n: int,
          per: Sequence[str] | None = None) -> DataFrame:
    """Keep the first ``n`` rows by ``order``.

    ``order`` must end in a unique key so the result is deterministic (the
    reference's TOP over ties is not).  Without ``per`` this plans as
    TakeOrderedAndProject: each task keeps its own n best rows and only those
    reach the final merge, so nothing unbounded crosses to one task.  With
    ``per`` it is ``row_number() <= n`` per key, which Spark plans as a
    partial WindowGroupLimit before the shuffle and a final one after it.
    """
    if not per:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
