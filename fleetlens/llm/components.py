"""Connected components of a distributed edge list by alternating large-star and small-star
steps: every step is a grouped minimum and an equi join, so a node with millions of
edges is pre-aggregated and its join is split by the adaptive planner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, written


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_lowest(both), "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    low = _lowest(down)
    return (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns ``u``, ``v``) that is not its
    component's smallest node; root is the smallest.  The number of rounds grows with the
    logarithm of a component's diameter; each round ends in a table in the shared folder."""
    now = written(edges.filter("u <> v").distinct(), label)
    mark = _mark(now)
    while mark[0]:
        new = written(_small_star(_large_star(now)), label)
        dropped(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
