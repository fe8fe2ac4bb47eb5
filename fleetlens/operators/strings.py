"""Ordered string aggregation (G15):
``STUFF((SELECT ', ' + x ... ORDER BY ... FOR XML PATH('')), 1, 2, '')``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_string_agg(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                       sep: str = ", ", alias: str | None = None) -> DataFrame:
    """One string per group, values joined in ``order``.

    Groups here are catalog-bounded (columns of one index, victims of one
    deadlock), so the per-group list is small.  ``collect_list`` of a struct
    sorted by its leading fields gives the order.
    """
    alias = alias or f"{value}_list"
    st = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).alias("_v"))
    agg = F.array_join(F.transform(F.array_sort(F.collect_list(st)), lambda x: x["_v"]), sep)
    return df.groupBy(*keys).agg(agg.alias(alias))


def distinct_string_agg(df: DataFrame, keys: Sequence[str], value: str, sep: str = ", ",
                        alias: str | None = None) -> DataFrame:
    """Distinct values in ascending order, joined (``array_sort(collect_set())``)."""
    alias = alias or f"{value}_list"
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(alias))
