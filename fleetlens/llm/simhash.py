"""SimHash near-duplicates found by pigeonring filtering.

A text's fingerprint is the majority of the 64-bit XXH64 hashes (seed 42) of its word
shingles.  Two fingerprints within DISTANCE = 2 bits are linked.  The 64 bits form a ring of
SEGMENTS = 5 segments; by the pigeonring principle a linked pair has a start from which the
first l segments differ in at most l * 2 / 5 bits for every l, that is in 0, 0, 1, 1, 2 bits.  The first two
give an exact join key of 26 bits per start; the next two are checked before the full Hamming distance.

Equal fingerprints are one class before any pair is looked at.  A key's distinct fingerprints
are linked inside one task by a search that emits at most one edge per fingerprint, never all
pairs; a key held by more than HOT fingerprints is first split by its third segment, each
fingerprint visiting its own value and those one bit away (the budget there is one bit), which loses no link.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated
rows share a class; an empty table gives an empty result; de-duplication keeps one row of each component, whatever its ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import add_columns, free_name, written
from fleetlens.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
WIDTHS = (13, 13, 13, 13, 12)
HOT = 20_000

_SHIFTS = tuple(sum(WIDTHS[:k]) for k in range(len(WIDTHS)))
_MASKS = tuple(((1 << w) - 1) << s for w, s in zip(WIDTHS, _SHIFTS))
_COUNT = 1 << 16  # hashes added up at a time


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text (ASCII letters in lower case)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = len(words) - size + 1
    if n < 2:
        hashes = iter((xxhash.xxh64_intdigest(b" ".join(words), SEED),))
        n = 1
    else:
        hashes = (xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(size)))))
    h = np.fromiter(hashes, np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _COUNT):
        bits = np.unpackbits(h[at:at + _COUNT].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the fingerprint as a long (two's complement); the second value names the column."""
    name = free_name(docs, "fingerprint")

    def work(texts: list) -> list[list]:
        return [np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64).tolist()]

    return add_columns(docs, text, {name: "long"}, lambda: work), name


def _segment(fp: Column, k: int) -> Column:
    k %= len(WIDTHS)
    return F.shiftrightunsigned(fp, _SHIFTS[k]).bitwiseAND(F.lit((1 << WIDTHS[k]) - 1))


def _links(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``fps`` (distinct) that pass the ring's budgets from ``start``."""
    third = np.uint64(_MASKS[(start + 2) % 5])
    fourth = np.uint64(_MASKS[(start + 3) % 5]) | third

    def near(x: np.uint64, others: np.ndarray) -> np.ndarray:
        d = x ^ others
        ok = np.bitwise_count(d & third) <= 1
        ok &= np.bitwise_count(d & fourth) <= 1
        return ok & (np.bitwise_count(d) <= DISTANCE)

    edges, left = [], fps
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        hit = near(x, left)
        if hit.any():
            found = left[hit]
            edges += [(int(x), int(y)) for y in found]
            queue += list(found)
            left = left[~hit]
    return edges


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, fp) sorted by key and sub: the edges inside each run of equal (key, sub)."""
    rest: tuple | None = None

    def pairs_of(key: np.ndarray, sub: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        change = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
        starts, ends = np.append(0, change), np.append(change, len(key))
        u, v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        two = starts[ends - starts == 2]  # most groups are pairs: all of them at once
        if len(two):
            a, b, k = fp[two], fp[two + 1], (key[two] >> 26) % 5
            masks = np.array(_MASKS, np.uint64)
            third = masks[(k + 2) % 5]
            d = a ^ b
            ok = ((np.bitwise_count(d & third) <= 1) & (np.bitwise_count(d & (third | masks[(k + 3) % 5])) <= 1)
                  & (np.bitwise_count(d) <= DISTANCE))
            u.append(a[ok])
            v.append(b[ok])
        for s, e in zip(*(x[ends - starts > 2] for x in (starts, ends))):
            if edges := _links(np.unique(fp[s:e]), int(key[s] >> 26)):
                a, b = zip(*edges)
                u.append(np.array(a, np.uint64))
                v.append(np.array(b, np.uint64))
        return np.concatenate(u), np.concatenate(v)

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])

    for batch in batches:
        part = tuple(batch.column(k).to_numpy() for k in range(2)) + (batch.column(2).to_numpy().astype(np.uint64),)
        if rest is not None:
            part = tuple(np.concatenate(x) for x in zip(rest, part))
        if not len(part[0]):
            continue
        key, sub, _ = part
        cut = len(key) - int(np.argmax(((key != key[-1]) | (sub != sub[-1]))[::-1])) if (key[0], sub[0]) != (key[-1], sub[-1]) else 0
        rest = tuple(x[cut:] for x in part)
        if cut:
            yield out(*pairs_of(*(x[:cut] for x in part)))
    if rest is not None and len(rest[0]):
        yield out(*pairs_of(*rest))


def link_fingerprints(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints ``fps`` (long column ``fp``)
    within DISTANCE bits: every link's ends are joined by a path of edges, and every edge is a link."""
    fp = F.col("fp")
    keys = fps.select("fp", F.explode(F.array(*[
        F.lit(k << 26).bitwiseOR(F.shiftleft(_segment(fp, k), 13)).bitwiseOR(_segment(fp, k + 1))
        for k in range(5)])).alias("key"))
    crowded = keys.groupBy("key").count().filter(F.col("count") > hot).select("key", F.lit(True).alias("hot"))
    third = F.lit(None).cast("long")
    for k in range(5):
        third = F.when(F.shiftright("key", 26) == k, _segment(fp, k + 2)).otherwise(third)
    visits = F.when(F.col("hot"), F.concat(F.array(third), F.transform(
        F.sequence(F.lit(0), F.lit(12)), lambda b: third.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))))
    spread = (keys.join(crowded, "key", "left")
              .select("key", "fp", F.explode(F.coalesce(visits, F.array(F.lit(-1).cast("long")))).alias("sub")))
    return (spread.repartition("key", "sub").sortWithinPartitions("key", "sub").select("key", "sub", "fp")
            .mapInArrow(_link_groups, "u long, v long"))


def _rooted(rows: DataFrame, first: Column) -> DataFrame:
    """The classes of equal fingerprints of ``rows`` (column ``fp``): ``fp``, the aggregate ``first`` of
    the class, and ``root``, one value per component."""
    classes = rows.groupBy("fp").agg(first.alias("first"))
    roots = components(link_fingerprints(classes.select("fp")), "simhash-links")
    rooted = (classes.join(roots, classes["fp"] == roots["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    return written(rooted, "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (long) and ``component_id``, the smallest id
    reachable over links (null ids have no say unless a component has no other)."""
    own, name = add_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")), "_text")
    rows = written(own.select("doc_id", F.col(name).alias("fp")), "simhash-rows")
    rooted = _rooted(rows, F.min("doc_id"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component of ``docs``: that with the smallest id (null ids last) and, of several texts with
    that id, the one with the smallest SHA-256 (null first).  Rows of equal id and text are in one component, so that
    pair finds the row again; ids may be null or repeated over different texts."""
    def digest(column: str) -> Column:
        return F.coalesce(F.sha2(F.col(column).cast("binary"), 256), F.lit(""))

    own, name = add_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")), "_text")
    rows = written(own.select("doc_id", digest("_text").alias("digest"), F.col(name).alias("fp")), "simhash-rows")
    rooted = _rooted(rows, F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest")))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    key = free_name(docs, "_digest")
    keep = best.select(F.col("best.doc_id").alias("_id"), F.col("best.digest").alias("_of"))
    marked = docs.withColumn(key, digest(text))
    return (marked.join(keep, marked[id_col].eqNullSafe(keep["_id"]) & (marked[key] == keep["_of"]), "left_semi")
            .dropDuplicates([id_col, key]).drop(key))
