"""Join-shaped operators: name resolution (G02), handle lookups (G04),
unused keys (G13) and blocker/blocked pairs (G21).

Joins are plain equi joins on the fleet key (``instance_id`` first).  No
broadcast hint is forced: the planner broadcasts a side only when its size is
below ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks the measured
size at run time) and uses a shuffle join beyond it; a side that ``shuffled``
names is never broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLEET = ["instance_id"]


def with_index_names(fact: DataFrame, indexes: DataFrame, objects: DataFrame, schemas: DataFrame,
                     named_only: bool = True, user_only: bool = True, user_tables_only: bool = False,
                     index_cols=()) -> DataFrame:
    """Attach schema, table and index names to rows keyed by
    ``(instance_id, database_id, object_id, index_id)`` (G02).

    ``user_only`` drops system objects (``is_ms_shipped``), ``user_tables_only``
    keeps objects of type ``U``, ``named_only`` drops heaps (index name NULL),
    as each report asks.  ``index_cols`` are extra columns of ``indexes`` to
    carry (names or Columns).  Plain equi joins on the full key: the catalog
    sides are broadcast by the planner when they are small enough.
    """
    db = ["instance_id", "database_id"]
    obj, idx = db + ["object_id"], db + ["object_id", "index_id"]
    o = objects
    if user_only:
        o = o.filter(~F.col("is_ms_shipped"))
    if user_tables_only:
        o = o.filter(F.col("type") == "U")
    o = o.select(*obj, "schema_id", F.col("name").alias("table_name"), F.col("type_desc").alias("object_type_desc"))
    i = indexes.select(*idx, F.col("name").alias("index_name"), *index_cols)
    if named_only:
        i = i.filter(F.col("index_name").isNotNull())
    s = schemas.select(*db, "schema_id", F.col("name").alias("schema_name"))
    return fact.join(i, idx).join(o, obj).join(s, db + ["schema_id"])


#: Bits of a key filter (a power of two), and bits that each key sets.
FILTER_BITS = 1 << 21
_SET = 3


def _places(keys: Sequence[str]) -> Column:
    """The bits of a key."""
    h = F.xxhash64(*keys)
    return F.array(*[F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(_SET)])


def key_filter(needed: DataFrame, on: Sequence[str]) -> Column:
    """A Bloom filter of the keys that ``needed`` has: one array of FILTER_BITS bits, as a scalar subquery."""
    place = needed.select(*on).select(F.explode(_places(on)).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("bits"))
    all_ = needed.sparkSession.range(FILTER_BITS // 64).join(words, F.col("id") == F.col("word"), "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    # one group of FILTER_BITS / 64 rows, whatever the input
    return all_.groupBy(F.shiftright("id", 40).alias("one")).agg(ordered["bits"].alias("bits")).select("bits").scalar()


def kept_by_keys(lookup: DataFrame, needed: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``lookup`` whose key ``needed`` has (and a few others): tested in the scan, so a wide column of a
    row that nobody asks for crosses no exchange."""
    bits = key_filter(needed, on)
    places = _places(on)
    tests = [F.bit_get(F.get(bits, F.shiftright(places[k], 6).cast("int")), (places[k] % 64).cast("int")) == 1 for k in range(_SET)]
    return lookup.filter(reduce(lambda a, b: a & b, tests))


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size, from the sizes of its files; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` of a join that is never broadcast, for tables that grow with the fleet.

    The planner allows a broadcast by a table's size in files, which says little about its rows: packed columns take many times
    their bytes in the driver, which collects and keeps every broadcast of a query."""
    return side.hint("merge")


def _too_large_to_broadcast(df: DataFrame) -> bool:
    return planned_bytes(df) > df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def resolve_handle(df: DataFrame, lookup: DataFrame, on: Sequence[str],
                   how: str = "inner", needed: DataFrame | None = None) -> DataFrame:
    """``CROSS APPLY`` (``how='inner'``) / ``OUTER APPLY`` (``'left'``) of a
    handle-keyed row-set function landed as a table (G04).

    A lookup that the planner's estimate allows to broadcast is joined as it is.  A larger one is first reduced, in its scan, to the
    keys that ``df`` has (``kept_by_keys``): ``df`` should hold few and narrow rows by then.  The keys are computed beside the
    join, so ``df`` is run a second time for them; where that is dear, ``needed`` names cheaper rows that have all of ``df``'s keys."""
    on = list(on)
    if _too_large_to_broadcast(lookup):
        lookup = kept_by_keys(lookup, df if needed is None else needed, on)
    return df.join(lookup, on, how)


def resolve_text(df: DataFrame, sql_texts: DataFrame, handle: str = "sql_handle", how: str = "inner",
                 alias: str = "text") -> DataFrame:
    """Batch text of each row's handle: ``CROSS APPLY sql_text(handle)``
    (``how='inner'``) or ``OUTER APPLY`` (``'left'``) (G04)."""
    t = sql_texts.select("instance_id", F.col("sql_handle").alias(handle), F.col("text").alias(alias))
    return resolve_handle(df, t, ["instance_id", handle], how)


def resolve_plan(df: DataFrame, plans: DataFrame, how: str = "inner") -> DataFrame:
    """Plan XML of each row's plan handle: ``CROSS / OUTER APPLY query_plan(plan_handle)``."""
    return resolve_handle(df, plans.select("instance_id", "plan_handle", "query_plan"),
                          ["instance_id", "plan_handle"], how)


def unused_keys(inventory: DataFrame, usage: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inventory rows with no usage row: ``LEFT JOIN ... IS NULL`` as a left anti join."""
    return inventory.join(usage.select(*on), list(on), "left_anti")


def blocking_pairs(blocked: DataFrame, blockers: DataFrame,
                   keys: Sequence[str] = ("instance_id", "captured_at")) -> DataFrame:
    """Pair each waiting request with its blocking session (G21): equi join of
    ``blocked.blocking_session_id`` to ``blockers.session_id`` inside one
    instance and one sample."""
    keys = list(keys)
    b = blockers.withColumnRenamed("session_id", "blocking_session_id")
    return blocked.join(b, keys + ["blocking_session_id"])
