"""Telemetry tables as DataFrames.

``Telemetry(spark, sf_dir)`` exposes each telemetry table by name.  Tables are
derived lazily from the test tables by the SQL in ``derive.py`` (one SQL text
serves Spark and the DuckDB oracle); on a real fleet the same names are read
from landed parquet with ``read_landed``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.scope import capture_at, latest_capture
from . import derive

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


class Telemetry:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        key = "base:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._cache[key]

    def __getitem__(self, name: str) -> DataFrame:
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name not in self._cache:
            sql, deps = derive.spark_sql(name)
            kwargs = {d: self.table(d) for d in deps}
            self._cache[name] = self.spark.sql(sql, **kwargs)
        return self._cache[name]

    def captures(self, name: str) -> DataFrame:
        """All captures of a view, with ``captured_at``."""
        return self.table(f"{name}_captures")

    def now(self, name: str) -> DataFrame:
        """The capture that a point-in-time report, or the end of a delta, reads."""
        return capture_at(self.captures(name), derive.POST_CAPTURE)

    def before(self, name: str) -> DataFrame:
        """The capture that a delta starts from."""
        return capture_at(self.captures(name), derive.PRE_CAPTURE)


def read_landed(spark: SparkSession, path: str, schema=None, captured_from=None,
                captured_to=None, table: str | None = None) -> DataFrame:
    """Read a landed telemetry table (parquet, partitioned by ``capture_date``).

    Capture bounds become partition filters, so only the needed days are
    listed and read.  With ``table`` the columns are checked against that
    table's schema (``sources.schemas``) at load."""
    from pyspark.sql import functions as F

    from .schemas import check_schema
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    if table is not None:
        check_schema(df, table)
    if captured_from is not None:
        df = df.filter(F.col("captured_at") >= F.lit(captured_from))
        if "capture_date" in df.columns:
            df = df.filter(F.col("capture_date") >= F.to_date(F.lit(captured_from)))
    if captured_to is not None:
        df = df.filter(F.col("captured_at") <= F.lit(captured_to))
        if "capture_date" in df.columns:
            df = df.filter(F.col("capture_date") <= F.to_date(F.lit(captured_to)))
    return df


def write_landed(df: DataFrame, path: str, mode: str = "append", max_records_per_file: int = 5_000_000) -> None:
    """Land a capture, partitioned by capture date.

    Tables without ``captured_at`` (catalogs, texts, plans) are written as they are.
    No shuffle before the write: each task writes its own rows per date, so
    an instance holding a third of a capture is spread over the tasks that
    read it instead of landing in one; rows are sorted by instance inside
    each task so parquet row-group statistics prune by instance on read."""
    from pyspark.sql import functions as F
    if "captured_at" not in df.columns:
        df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file).parquet(path)
        return
    (df.withColumn("capture_date", F.to_date("captured_at"))
       .sortWithinPartitions("capture_date", "instance_id")
       .write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
       .partitionBy("capture_date").parquet(path))


class LandedTelemetry:
    """The same table-by-name interface over landed parquet: ``root/<name>``.

    Every registered report can then run on a fleet's landed captures
    instead of the stand-in tables (``python -m fleetlens run <name>
    --landed ROOT``).  Point-in-time reports read the capture ``end`` (each server's newest one
    if it is not given), deltas go from the capture ``start`` to it; both are pruned by
    ``capture_date``.  ``captured_from`` and ``captured_to`` bound what tables of many
    captures are read for.  Known tables are schema-checked at load."""

    def __init__(self, spark: SparkSession, root: str, captured_from=None, captured_to=None, start=None, end=None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.captured_from, self.captured_to = captured_from, captured_to
        self.start, self.end = start, end
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return self.table(name)

    def _read(self, name: str) -> DataFrame:
        if name not in self._cache:
            from .schemas import TELEMETRY_SCHEMAS, check_schema
            path = f"{self.root}/{name}"
            df = self.spark.read.parquet(path)
            if "captured_at" in df.columns and (self.captured_from or self.captured_to):
                df = read_landed(self.spark, path, captured_from=self.captured_from, captured_to=self.captured_to)
            if name in TELEMETRY_SCHEMAS:
                check_schema(df, name)
            if "captured_at" not in df.columns and name in derive.CAPTURED:
                raise ValueError(f"telemetry table {name}: missing captured_at")
            self._cache[name] = df
        return self._cache[name]

    def table(self, name: str) -> DataFrame:
        df = self._read(name.removesuffix("_captures"))
        return df.drop("capture_date")

    def captures(self, name: str) -> DataFrame:
        return self._read(name)

    def now(self, name: str) -> DataFrame:
        if self.end is not None:
            return capture_at(self._read(name), self.end)
        return latest_capture(self._read(name)).drop("captured_at", "capture_date")

    def before(self, name: str) -> DataFrame:
        if self.start is None:
            raise ValueError("a delta needs the capture it starts from: LandedTelemetry(..., start=, end=)")
        return capture_at(self._read(name), self.start)
