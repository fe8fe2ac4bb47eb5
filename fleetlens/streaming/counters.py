"""ST1: continuous form of the one-second counter sampler.

Samples arrive as landed parquet files, in any order.  Every micro-batch is reduced to
one row per counter and tumbling window (first and last value with their times, and the number of
samples) and written to its own ``batch_id=`` folder (overwritten on retry, so a
replayed batch is idempotent).  Readers merge the rows of a window over all batches, so a
sample that arrives hours late still counts: there is no watermark and no state to drop it from.
Compaction merges the folders written so far, which keeps reads cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .folders import complete_folders, remove_folder

COUNTER_KEYS = ["instance_id", "object_name", "counter_name", "instance_name"]
SAMPLE_SCHEMA = ("instance_id STRING, object_name STRING, counter_name STRING, instance_name STRING, "
                 "captured_at TIMESTAMP_NTZ, cntr_value BIGINT")
OUT_COLS = COUNTER_KEYS + ["window_start", "window_end", "open_value", "close_value", "change", "samples"]
PART_COLS = COUNTER_KEYS + ["window_start", "window_end", "opened", "closed", "samples"]


def partial_windows(samples: DataFrame, window: str = "5 minutes") -> DataFrame:
    """One mergeable row per counter and window: ``opened`` and ``closed`` are (time, value).

    Capture times are wall-clock (``TIMESTAMP_NTZ``); windows are cut on them as instants in the
    session time zone (UTC by the library's defaults) and given back as wall clock."""
    at = F.struct(F.col("captured_at").alias("at"), F.col("cntr_value").alias("value"))
    g = samples.groupBy(F.window(F.col("captured_at").cast("timestamp"), window).alias("w"), *COUNTER_KEYS).agg(
        F.min(at).alias("opened"), F.max(at).alias("closed"), F.count("*").alias("samples"))
    return g.select(*COUNTER_KEYS, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "opened", "closed", "samples")


def merge_windows(parts: DataFrame) -> DataFrame:
    """The rows of every window as one."""
    return parts.groupBy(*COUNTER_KEYS, "window_start", "window_end").agg(
        F.min("opened").alias("opened"), F.max("closed").alias("closed"), F.sum("samples").alias("samples")).select(*PART_COLS)


def _result(parts: DataFrame) -> DataFrame:
    first, last = F.col("opened.value"), F.col("closed.value")
    return parts.select(*COUNTER_KEYS, "window_start", "window_end", first.alias("open_value"), last.alias("close_value"),
                        (last - first).alias("change"), "samples")


def counter_windows(samples: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Open, close and change per counter and window of a batch of samples."""
    return _result(partial_windows(samples, window))


def start_counter_stream(spark: SparkSession, source: str, out: str, checkpoint: str, window: str = "5 minutes",
                         available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Keep the windows under ``out`` up to date with the samples landed in ``source``; every sample
    counts whenever it arrives.  ``max_files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(SAMPLE_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def sink(batch: DataFrame, batch_id: int) -> None:
        partial_windows(batch, window).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = reader.parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_counter_windows(spark: SparkSession, out: str, compacted: str | None = None,
                         compacted_before: int | None = None) -> DataFrame:
    """Current result: every (counter, window) over all complete batches.

    With a ``compacted`` copy (:func:`compact_counter_windows`), only the batches from its own stored bound on are read besides
    it.  A copy without one raises unless ``compacted_before`` names the first batch that it lacks."""
    folders, first = [], 0
    if compacted is not None:
        copies = complete_folders(spark, compacted, ("before",))
        if copies:
            first, _, folder = copies[-1]
        elif compacted_before is not None:
            first, folder = compacted_before, compacted
        else:
            raise ValueError(f"{compacted} doesn't say which batches it holds; compact again or pass compacted_before")
        folders = [folder]
    folders += [folder for number, _, folder in complete_folders(spark, out, ("batch_id",)) if number >= first]
    parts = spark.read.parquet(*folders) if folders else spark.read.parquet(out)
    return _result(merge_windows(parts.select(*PART_COLS))).select(*OUT_COLS)


def compact_counter_windows(spark: SparkSession, out: str, into: str, before_batch: int | None = None) -> None:
    """Merge the windows of the batches written so far (or those before ``before_batch``) into one copy
    ``into/before=<first batch it lacks>``, so readers of a long-running stream scan it plus the newer batches
    instead of every batch ever written.  A reader finds the bound in the folder's name; older copies go once the new one is
    complete.  The batches' folders are left as they are."""
    found = [f for f in complete_folders(spark, out, ("batch_id",)) if before_batch is None or f[0] < before_batch]
    if not found:
        return
    bound = found[-1][0] + 1 if before_batch is None else before_batch
    older = [f for f in complete_folders(spark, into, ("before",)) if f[0] < bound]
    parts = spark.read.parquet(*[folder for _, _, folder in found])
    merge_windows(parts).write.mode("overwrite").parquet(f"{into}/before={bound:010d}")
    for _, _, folder in older:
        remove_folder(spark, folder)
