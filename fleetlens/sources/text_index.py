"""A search structure for needles in texts (G19; R30-R34, R45): which files can hold one.

Texts are landed as parquet files; beside them, ``grams`` holds for every file the set of its runs of GRAM characters (lower case), as
a bit set.  A text that contains a needle contains all the needle's grams, so only files with all of them (or files that
are not in the sidecar yet) have to be opened; the needle itself is still tested on every row read.

A file's set is bounded (BITS bits), and so is the driver's part: names of files, which listing a folder
brings to it anyway.  Needles shorter than GRAM open all files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a gram, and bits of a file's set (a power of two).
GRAM = 4
BITS = 1 << 20


def _place(gram: Column) -> Column:
    return F.xxhash64(gram).bitwiseAND(F.lit(BITS - 1))


#: Characters whose grams are told apart at a time: bounds a task's memory, whatever the texts' lengths.
CHUNK = 1 << 21


def _distinct_grams(texts: list[str]) -> list[str]:
    """The distinct grams of some texts."""
    text = "".join(texts)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(code) < GRAM:
        return []
    chars = np.flatnonzero(np.bincount(code))   # numbered from 0 in their order
    number = np.zeros(chars[-1] + 1, np.uint32)
    number[chars] = np.arange(len(chars), dtype=np.uint32)
    code = number[code]
    bits = max(1, int(len(chars) - 1).bit_length())
    if bits * GRAM > 64:   # over 65,536 different characters among the texts
        return [*{t[i:i + GRAM] for t in texts for i in range(len(t) - GRAM + 1)}]
    n = len(code) - GRAM + 1
    wide = np.uint32 if bits * GRAM <= 32 else np.uint64
    key = np.zeros(n, wide)
    for k in range(GRAM):
        key = (key << wide(bits)) | code[k:k + n].astype(wide)
    inside = np.ones(n, bool)   # a gram doesn't reach from one text into the next
    ends = np.cumsum([len(t) for t in texts])
    for k in range(1, GRAM):
        at = ends - k
        inside[at[(at >= 0) & (at < n)]] = False
    key = np.sort(key[inside])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    at = [(key >> wide(bits * (GRAM - 1 - k))) & wide((1 << bits) - 1) for k in range(GRAM)]
    joined = np.stack([chars[a.astype(np.int64)] for a in at], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i:i + GRAM] for i in range(0, len(joined), GRAM)]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, gram) of rows (file, lower-case text): the distinct grams of each chunk of a file's texts."""
    for b in batches:
        texts: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for file, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py() or ""
            for i in range(0, max(len(text) - GRAM + 1, 0), CHUNK):   # pieces of a long text overlap, so each gram is whole in one
                piece = text[i:i + CHUNK + GRAM - 1]
                texts.setdefault(file, []).append(piece)
                size[file] = size.get(file, 0) + len(piece)
                if size[file] >= CHUNK:
                    yield _rows(file, texts.pop(file))
                    del size[file]
        for file, some in texts.items():
            yield _rows(file, some)


def _rows(file: str, texts: list[str]) -> pa.RecordBatch:
    grams = _distinct_grams(texts)
    return pa.RecordBatch.from_arrays([pa.array([file] * len(grams), pa.string()), pa.array(grams, pa.string())], ["file", "gram"])


def _file() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


def write_texts(texts: DataFrame, path: str, text: str = "text", max_records_per_file: int = 20_000) -> None:
    """Add ``texts`` to the files under ``path``/texts and every file that is new to the sidecar.

    A run that stops between the two leaves files without a set; they are read by every search and get their set
    with the next call."""
    texts.write.mode("append").option("maxRecordsPerFile", max_records_per_file).parquet(f"{path}/texts")
    spark = texts.sparkSession
    new = sorted(set(_files(spark, path)) - set(_indexed(spark, path)))
    if not new:
        return
    rows = spark.read.schema(texts.schema).parquet(*[f"{path}/texts/{f}" for f in new])
    rows = rows.select(_file().alias("file"), F.col(text).alias("text"))
    cores = spark.sparkContext.defaultParallelism
    if len(new) < cores or rows.rdd.getNumPartitions() < cores:   # a small addition is dealt out over all cores
        rows = rows.repartition(cores)
    grams = rows.select("file", F.lower("text").alias("text")).mapInArrow(_grams, "file string, gram string")
    places = grams.select("file", _place(F.col("gram")).alias("place"))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("bits")
    words = places.groupBy("file", F.shiftright("place", 6).alias("word")).agg(word)
    all_files = spark.createDataFrame([(f,) for f in new], "file string")   # files without any gram have an empty set
    all_files.join(words, "file", "left").repartition("file").sortWithinPartitions("file", "word").write.mode("append").parquet(f"{path}/grams")


def _files(spark: SparkSession, path: str) -> list[str]:
    return [f.rsplit("/", 1)[1] for f in spark.read.parquet(f"{path}/texts").inputFiles()]


def _indexed(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/grams")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return [r[0] for r in spark.read.parquet(f"{path}/grams").select("file").distinct().collect()]


def files_that_may_hold(spark: SparkSession, path: str, needles: Sequence[str]) -> list[str]:
    """Names of the files that can hold one of ``needles``: their sets have all its grams, or they have no set."""
    files, indexed = set(_files(spark, path)), set(_indexed(spark, path))
    wanted = [(n, low[i:i + GRAM]) for n in needles for low in [n.lower()] for i in range(len(low) - GRAM + 1)]
    if not indexed or len({n for n, _ in wanted}) < len(set(needles)):
        return sorted(files)
    asked = spark.createDataFrame(sorted(set(wanted)), "needle string, gram string").withColumn("place", _place(F.col("gram")))
    asked = asked.select("needle", F.shiftright("place", 6).alias("word"), (F.col("place") % 64).cast("int").alias("bit")).distinct()
    sizes = asked.groupBy("needle").agg(F.count("*").alias("wanted"))
    sets = spark.read.parquet(f"{path}/grams")
    met = sets.join(F.broadcast(asked), "word").filter(F.bit_get("bits", F.col("bit")) == 1)   # a row for each gram of the needles
    whole = met.groupBy("file", "needle").agg(F.count("*").alias("met")).join(F.broadcast(sizes), "needle").filter("met = wanted")
    return sorted((files - indexed) | {r[0] for r in whole.select("file").distinct().collect()} & files)


def read_texts_with(spark: SparkSession, path: str, needles: Sequence[str], text: str = "text") -> DataFrame:
    """The rows of the texts under ``path`` that contain one of ``needles`` (case-insensitive), reading only files that may hold one."""
    from ..functions.text import contains_ci

    schema = spark.read.parquet(f"{path}/texts").schema
    files = files_that_may_hold(spark, path, needles)
    rows = spark.read.schema(schema).parquet(*[f"{path}/texts/{f}" for f in files]) if files else spark.createDataFrame([], schema)
    return rows.filter(reduce(lambda a, b: a | b, [contains_ci(text, n) for n in needles]))
