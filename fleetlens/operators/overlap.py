"""Rows whose ordered column list equals, or is a prefix of, another
row's list in the same group (either direction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_overlap(df: DataFrame, group: Sequence[str], items: str, id_col: str,
                   sep: str = ", ") -> DataFrame:
    """Keep rows R for which another row S of the group (``S.id <> R.id``) has
    ``R.list`` as a prefix of ``S.list`` or ``S.list`` as a prefix of ``R.list``.

    ``items`` is an array column of list elements; prefixes are taken at
    element boundaries and compared as joined strings (the reference compares
    the rendered text with ``LIKE LEFT(...)``; wildcards are taken literally).

    No pair of rows is ever formed: every row emits its prefixes (an index has at most a few
    dozen key columns) with its key only, and per ``(group, prefix)`` two counts are taken with one window:
    ``n`` = rows having that prefix, ``f`` = rows whose whole list is it.
    Then per row, over the row's own prefixes (the other columns are joined to the winners):

    * R's list is a prefix of another row's iff ``n(R.list) >= 2``;
    * another row's list is a prefix of R's iff ``sum over R's prefixes of
      f >= 2`` (R itself counts once, at its full list).

    Rows with a NULL / empty list or NULL id never match.
    """
    g = list(group)
    base = df.filter(F.col(items).isNotNull() & (F.size(items) > 0) & F.col(id_col).isNotNull()).select(*g, id_col, items)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(items)),
                           lambda i: F.array_join(F.slice(F.col(items), F.lit(1), i), sep))
    pref = base.select(*g, id_col, F.posexplode(prefixes).alias("_k", "_p"), (F.size(items) - 1).alias("_last"))
    pref = pref.withColumn("_is_full", (F.col("_k") == F.col("_last")).cast("int"))
    by_prefix = Window.partitionBy(*g, "_p")
    pref = pref.withColumn("_n", F.count("*").over(by_prefix)).withColumn("_f", F.sum("_is_full").over(by_prefix))
    per_row = pref.groupBy(*g, id_col).agg(F.max(F.when(F.col("_is_full") == 1, F.col("_n"))).alias("_down"), F.sum("_f").alias("_up"))
    hits = per_row.filter((F.col("_down") >= 2) | (F.col("_up") >= 2)).select(*g, id_col)
    return df.join(hits, [*g, id_col], "left_semi")
