"""ST2: the usage ledger (G12) kept up to date by micro-batch.

Each micro-batch holds one or more captures; they are folded into the ledger in order of
capture time, and only the rows of the keys they touch are written, as ``delta=<batch_id>``
(overwritten on retry).  Every COMPACT_EVERY batches the whole ledger is written once as
``full=<batch_id>``.  Readers take the newest full version and the newest row of every key in the
deltas after it; reading back from parquet cuts the lineage between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import latest_per_key, upsert_intervals, upsert_ledger
from ..plans.maintenance import LEDGER_KEYS
from .folders import complete_folders, remove_folder

CAPTURE_SCHEMA = ("instance_id STRING, database_id INT, database_name STRING, schema_name STRING, table_name STRING, "
                  "index_name STRING, table_id INT, index_id INT, fill_factor INT, read_usage BIGINT, "
                  "update_usage BIGINT, captured_at TIMESTAMP_NTZ")

#: Batches between two full versions.
COMPACT_EVERY = 16
#: Rows of the ledger and its captures that one task works on at a time, about.
ROWS_PER_TASK = 500_000


def read_ledger(spark: SparkSession, path: str, before: int | None = None, keys=LEDGER_KEYS) -> DataFrame | None:
    """The ledger after all batches (strictly older than ``before`` when given), or None
    if there is none yet.  A folder that can't be read raises: it is never taken for a
    missing one, which would start the ledger anew and lose what it has accumulated."""
    rows = _parts(spark, path, before)
    if rows is None:
        return None
    rows = rows.repartition(tasks_for(rows), *keys)
    others = [c for c in rows.columns if c not in keys and c != "_batch"]
    return latest_per_key(rows, list(keys), ["_batch"], others).select(*[c for c in rows.columns if c != "_batch"])


def _parts(spark: SparkSession, path: str, before: int | None) -> DataFrame | None:
    """The rows of the newest full version and of the batches after it, with their batch (``_batch``)."""
    found = [f for f in complete_folders(spark, path, ("delta", "full")) if before is None or f[0] < before]
    full = max((number for number, kind, _ in found if kind == "full"), default=-1)
    rows = None
    for number, kind, folder in found:
        if (kind == "full" and number == full) or (kind == "delta" and number > full):
            part = spark.read.parquet(folder).withColumn("_batch", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
    return rows


def read_intervals(spark: SparkSession, path: str, before: int | None = None, keys=LEDGER_KEYS) -> DataFrame | None:
    """The intervals of every key after all batches: a batch writes all intervals of the keys it touches, so the newest one counts."""
    rows = _parts(spark, path, before)
    if rows is None:
        return None
    newest = F.max("_batch").over(Window.partitionBy(*keys))
    return rows.repartition(tasks_for(rows), *keys).withColumn("_newest", newest).filter("_batch = _newest").drop("_batch", "_newest")


def tasks_for(*tables: DataFrame) -> int:
    """How many tasks the rows of stored tables are dealt out to: they grow in number with the rows, not in size."""
    return sum(t.count() for t in tables) // ROWS_PER_TASK + 1


def touched(rows: DataFrame, batch: DataFrame, keys, parts: int | None = None) -> DataFrame:
    """The rows of keys that a batch has; NULL key parts are equal to each other, as in the ledger's own grouping.

    Both meet in one shuffle on the keys, dealt out to ``parts`` tasks if given: a batch may have every key of the ledger,
    so its keys are held whole by no task."""
    marks = batch.select(*keys).withColumn("_mark", F.lit(True))
    both = rows.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    both = both if parts is None else both.repartition(parts, *keys)
    seen = F.max("_mark").over(Window.partitionBy(*keys))
    return both.withColumn("_seen", seen).filter("_seen AND NOT _mark").drop("_mark", "_seen")


def start_ledger_stream(spark: SparkSession, source: str, ledger_path: str, checkpoint: str,
                        keys, counters, carry, keep: dict | None = None, compact_every: int = COMPACT_EVERY,
                        max_files_per_trigger: int | None = None) -> StreamingQuery:
    def fold(ledger: DataFrame | None, batch: DataFrame, parts: int) -> DataFrame:
        return upsert_ledger(ledger, batch, keys, counters, carry, keep=keep, parts=parts)

    return _start(spark, source, ledger_path, checkpoint, keys, fold, read_ledger, compact_every, max_files_per_trigger)


def start_interval_stream(spark: SparkSession, source: str, path: str, checkpoint: str, keys, counters, carry,
                          compact_every: int = COMPACT_EVERY, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """The ledger as intervals: a capture that arrives after newer ones still counts (``upsert_intervals``).  Read it with
    :func:`read_intervals` and ``ledger_of_intervals``."""
    def fold(intervals: DataFrame | None, batch: DataFrame, parts: int) -> DataFrame:
        return upsert_intervals(intervals, batch, keys, counters, carry, parts=parts)

    return _start(spark, source, path, checkpoint, keys, fold, read_intervals, compact_every, max_files_per_trigger)


def _start(spark: SparkSession, source: str, path: str, checkpoint: str, keys, fold, read, compact_every: int, max_files: int | None) -> StreamingQuery:
    reader = spark.readStream.schema(CAPTURE_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def apply(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch starts again from what was written before it, so it rewrites
        # the same result (and a re-applied capture changes nothing)
        known, stored = read(spark, path, before=batch_id, keys=keys), _parts(spark, path, batch_id)
        parts = tasks_for(batch) if stored is None else tasks_for(stored, batch)
        if known is not None:
            known = touched(known, batch, keys, parts)
        fold(known, batch, parts).write.mode("overwrite").parquet(f"{path}/delta={batch_id:010d}")
        found = complete_folders(spark, path, ("delta", "full"))
        fulls = [number for number, kind, _ in found if kind == "full" and number < batch_id]
        if sum(1 for number, kind, _ in found if kind == "delta" and number > (fulls[-1] if fulls else -1)) >= compact_every:
            read(spark, path, keys=keys).write.mode("overwrite").parquet(f"{path}/full={batch_id:010d}")
            for number, _, folder in found:
                if fulls and number < fulls[-1]:   # a replay of this batch starts from the full version before it
                    remove_folder(spark, folder)

    return (reader.parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
