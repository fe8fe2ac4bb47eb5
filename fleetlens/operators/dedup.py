"""Newest row per key (G10) and distinct pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   cols: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` per key (``row_number() = 1``).

    ``max(struct(order..., cols...))`` is an ordinary aggregate with map-side
    partial aggregation, so a key holding a third of all rows is reduced in
    every task before the shuffle; ties on ``order`` break on ``cols``.
    """
    keys, order, cols = list(keys), list(order), [c for c in cols if c not in keys]
    s = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                       *[F.col(c) for c in cols if c not in order])).alias("_m")
    out = df.groupBy(*keys).agg(s)
    sel = [F.col(f"_m._o{i}").alias(c) for i, c in enumerate(order)]
    sel += [F.col(f"_m.{c}").alias(c) for c in cols if c not in order]
    return out.select(*keys, *sel)


def distinct_pairs(df: DataFrame, cols: Sequence[str], parts: int | None = None) -> DataFrame:
    """``row_number() = 1`` used as de-duplication -> ``dropDuplicates``.

    With ``parts`` the rows are dealt out by ``cols`` to that many tasks before any task holds a set of them."""
    rows = df.select(*cols)
    return (rows if parts is None else rows.repartition(parts, *cols)).dropDuplicates(list(cols))
