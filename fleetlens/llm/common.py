"""Helpers shared by the training-data operators: table access, tables written
to the shared folder, and Arrow maps that keep batches small."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import ensure_checkpoint_dir

#: Rows of a batch are handed to Python in slices of at most this many bytes of text.
SLICE_BYTES = 4 << 20
BATCH_ROWS = 1000

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
          "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()),
          "array<string>": pa.list_(pa.string())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can read.

    Also keeps the session's Arrow batches to BATCH_ROWS rows: texts are long, and a batch is
    held several times over between the JVM and its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    return (set_dir or ensure_checkpoint_dir(spark)).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage
    ends there and a lost executor costs no recomputation of earlier steps."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove the files behind tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of ``column`` each (one row at least)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def add_columns(df: DataFrame, text: str, fields: dict[str, str],
                make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """``df`` with the columns ``fields`` (name to SQL type) computed from ``text``.

    ``make()`` runs once a task and returns a function from a list of texts (null
    as None) to one list per new column.
    """
    schema = T.StructType(df.schema.fields
                          + [T.StructField(k, T.StructType.fromDDL(f"x {v}")[0].dataType) for k, v in fields.items()])
    kinds = [_ARROW[v] for v in fields.values()]
    names = df.columns + list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                made = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    list(part.columns) + [pa.array(c, type=k) for c, k in zip(made, kinds)], names=names)

    return df.mapInArrow(run, schema)


def bounded_labels(labels: DataFrame, rows: int, id_col: str, label_col: str) -> DataFrame:
    """At most ``rows`` labelled ids, the first by hash of the id, so that the choice
    is the same on every run; the result is bounded, hence may be broadcast."""
    return (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
            .orderBy(F.xxhash64("_id"), "_id").limit(rows))
