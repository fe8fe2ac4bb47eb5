"""Exact substring de-duplication by bucket-pointer refinement over sampled suffixes.

Every byte covered by a string of LENGTH = 400 bytes that also starts anywhere else (same
document included) is removed; strings are judged on the input and never cross documents.

Sampling.  Every 400-byte string is represented by one of its q-grams (Q = 32), the one with the
smallest identifier (its anchor).  Equal strings have equal anchors at equal offsets, so only
anchors, about one in 140 bytes, are shuffled, each with the range of string starts it stands for.

Initial buckets are the anchors' q-grams.  A bucket whose members all have the same surroundings
is finished: its strings occur as often as it has members.  Only in buckets with different
surroundings are single strings compared, by refinement: they are sorted by the rank of their own bucket and that of the bucket at a
later offset, whose order gives the ranks for twice the depth; in rounds of depth 32, 64, 128, 256 and 400, strings
whose bucket nobody shares are finished, and the ranks of a round are reused by the next, at all later offsets.  Ranks
hold inside one bucket, so no global sort is needed; refined strings have equal q-grams in two lanes (128 bits).  Surroundings, which decide the finished
buckets and the copies in others that need no refinement, are compared by one lane (64 bits) inside one bucket, whose
64 bits are of the other lane but only cover the q-gram.

Scale.  Anchors that a text has twice or more with equal surroundings (periodic text has one at every
byte) leave its task as one row with their number and the runs of starts.  Buckets are counted with partial aggregation before the shuffle; a bucket with many members is
joined with its count by an equi join that the adaptive planner splits; one with more
than CROWDED different surroundings is refined by distributed counts of 128-bit identifiers (two lanes) instead of in one task.  Texts
travel packed (zstd) and only meet their own document's rows.

Defined results: ids are of any type, null ids are apart from all others; a null text counts as empty; documents under 400 bytes lose nothing; repeated
rows are copies of each other and lose all that is covered; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, slices, written

LENGTH = 400
Q = 32
#: Different surroundings of one q-gram that are refined inside one task.
CROWDED = 4000
#: Bytes worked on at a time, and contexts refined at a time.
_FLAT = 1 << 20
_CONTEXTS = 1500

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_LANES = ((_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)), (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)))


def _pair(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """64-bit identifiers of the pairs (a, b)."""
    m, k = _LANES[lane]
    x = a * m
    x ^= x >> _U(32)
    x += b * k
    x *= _STEP
    x ^= x >> _U(29)
    return x


def _gram_ids(b: np.ndarray, lane: int) -> np.ndarray:
    """Identifiers of the q-grams at every position: eight bytes identify themselves, and twice
    the identifier here is paired with the one at the later offset."""
    ids = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))
    for step in (8, 16):
        ids = _pair(ids[:-step], ids[step:], lane)
    return ids


def _sliding_argmin(ids: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest identifier (high half; leftmost of equals) in every run of ``width``."""
    key = (ids & _U(0xFFFFFFFF00000000)) | np.arange(len(ids), dtype=_U)
    n = len(key) - width + 1
    v = np.concatenate([key, np.full(-len(key) % width, ~_U(0))]).reshape(-1, width)
    head = np.minimum.accumulate(v, axis=1).ravel()
    tail = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:n], head[width - 1:width - 1 + n]) & _U(0xFFFFFFFF)).astype(np.int64)


def _deep_ids(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Identifiers of the strings of ``length`` bytes at ``start``, from the q-gram identifiers at later offsets."""
    out = length.astype(_U)
    for offset in range(0, int(length.max(initial=0)), Q):
        more = offset < length
        here = np.minimum(offset, length[more] - Q)
        out[more] = _pair(out[more], ids[start[more] + here], 1)
    return out


def _flat_anchors(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of byte strings of LENGTH at least: number of the string, position, range of distances
    back to the starts it stands for, q-gram identifier and identifier of the whole surroundings."""
    flat = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    ids = _gram_ids(flat, 0)
    low = _sliding_argmin(ids, LENGTH - Q + 1)
    edge = np.zeros(len(flat) + 1, np.int32)  # starts from which a string would cross into the next one
    edge[ends - LENGTH + 1] += 1
    edge[ends] -= 1
    start = np.flatnonzero(np.cumsum(edge[:len(low)]) == 0)
    at = low[start]
    change = np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))
    first, at = start[change], at[change]
    last = np.append(start[np.flatnonzero(change)[1:] - 1], start[-1])
    near, far = at - last, at - first
    u = _deep_ids(_gram_ids(flat, 1), first, last + LENGTH - first)
    u = _pair(u, (near * 65536 + far).astype(_U), 1)
    which = np.searchsorted(ends, first, side="right")
    return which, at - np.append(0, ends)[which], near, far, ids[at], u


def anchors(raw: bytes | list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`_flat_anchors` of any byte strings, in runs of about _FLAT bytes; very long ones in parts."""
    many: list[bytes] = []
    where: list[tuple[int, int]] = []

    def done() -> tuple[np.ndarray, ...]:
        which, at, *rest = _flat_anchors(many)
        place = np.array(where, np.int64)
        return (place[which, 0], at + place[which, 1], *rest)

    size = 0
    for i, r in enumerate([raw] if isinstance(raw, bytes) else raw):
        for at in range(0, len(r) - LENGTH + 1, _FLAT):
            many.append(r[at:at + _FLAT + LENGTH - 1])
            where.append((i, at))
            size += len(many[-1])
            if size >= _FLAT:
                yield done()
                many, where, size = [], [], 0
    if many:
        yield done()


def _once_per_text(*rows: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, pa.Array]:
    """The first of every text's anchors with equal bucket and surroundings, their number, and (null for one) the
    runs of starts of all of them."""
    which, at, near, far, g, u = rows
    order = np.lexsort((at, u, g, which))
    new = np.append(True, (which[order][1:] != which[order][:-1]) | (g[order][1:] != g[order][:-1]) | (u[order][1:] != u[order][:-1]))
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(order)))
    first = order[begin]
    lo, hi = (at - far)[order], (at - near)[order]
    # starts of one group that touch or overlap make one run; only groups of several have runs
    open_ = new | np.append(True, lo[1:] > hi[:-1] + 1)
    several = np.repeat(n > 1, n)
    head = np.flatnonzero(open_ & several)
    last = np.flatnonzero(np.append(open_[1:], True) & several)
    per_group = np.bincount(np.cumsum(new)[head] - 1, minlength=len(n))
    offsets = np.append(0, np.cumsum(per_group)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(lo[head].astype(np.int32)), pa.array(hi[last].astype(np.int32))], names=["lo", "hi"])
    runs = pa.ListArray.from_arrays(pa.array(offsets), pairs, mask=pa.array(n == 1))
    return tuple(x[first] for x in rows), n, runs


def _shared(ids: np.ndarray) -> np.ndarray:
    """Which identifiers occur more than once."""
    order = np.argsort(ids)
    s = ids[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(ids), bool)
    out[order] = np.append(False, same) | np.append(same, False)
    return out


def _ranks(values: np.ndarray) -> np.ndarray:
    """Ranks of the values in sorted order; equal values have equal ranks."""
    order = np.argsort(values)
    v = values[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(False, v[1:] != v[:-1])[:len(v)])
    return out


def refine(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All LENGTH-byte strings of the contexts that occur more than once among them: (context, offset in it).

    Every string starts in the bucket of its q-gram (both lanes).  A round sorts strings by the rank of their bucket and that of the
    bucket at a later offset; the ranks of the pairs are the buckets of the next round, for twice the depth.  Each round only looks at
    strings whose bucket is still shared, and at the later offsets of those."""
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    base = np.cumsum(sizes) - sizes
    count = sizes - LENGTH + 1
    context = np.repeat(np.arange(len(contexts)), count)
    here = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(count.sum())
    grams, depth = [_gram_ids(flat, lane) for lane in (0, 1)], Q
    keep = _shared(grams[0][here])
    context, here = context[keep], here[keep]
    bucket, step = np.full(len(flat), -1, np.int64), 0
    while len(here):
        # places whose next bucket this or a later round reads: those of the strings left, at all later offsets
        edges = np.bincount(here, minlength=len(flat)) - np.bincount(here + LENGTH - depth - step + 1, minlength=len(flat))[:len(flat)]
        where = np.flatnonzero(np.cumsum(edges) > 0)
        pair = (bucket[where], bucket[where + step]) if step else [_ranks(g[where]) for g in grams]
        bucket[where] = _ranks(pair[0] << 32 | pair[1])
        keep = np.bincount(bucket[here])[bucket[here]] > 1
        context, here = context[keep], here[keep]
        depth += step
        if depth == LENGTH:
            break
        step = min(depth, LENGTH - depth)
    return context, here - base[context]


def _string_ids(context: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Both lanes of the identifiers of all LENGTH-byte strings of a context, by the same rounds."""
    ids = [_gram_ids(np.frombuffer(context, np.uint8), lane) for lane in (0, 1)]
    depth = Q
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        ids = [_pair(x[:-step], x[step:], lane) for lane, x in enumerate(ids)]
        depth += step
    return ids[0], ids[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, _U).view(np.int64))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(values) != 1)
    return values[np.append(0, cut + 1)], values[np.append(cut, len(values) - 1)]


def _keys(ids: list[str | None], raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of 128-bit digests of rows' ids (null apart from every other) and texts."""
    sums = b"".join(hashlib.blake2b(r, digest_size=16, key=b"null" if i is None else hashlib.sha256(i.encode()).digest()).digest() for i, r in zip(ids, raws))
    both = np.frombuffer(sums, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def packed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc_id``, the key (``_id``, ``_k``; rows of equal key have equal ids and texts, hence equal results),
    ``n_bytes`` and the compressed text ``z``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                raws = [(t or "").encode() for t in part.column("_text").to_pylist()]
                high, low = _keys(part.column("_id").to_pylist(), raws)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(high), pa.array(low),
                     pa.array([len(r) for r in raws], pa.int64()),
                     pa.array([pa.compress(r, "zstd", asbytes=True) for r in raws], pa.binary())],
                    names=["doc_id", "_id", "_k", "n_bytes", "z"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("_id"), F.col(text).alias("_text"))
            .mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, _id long, _k long, n_bytes long, z binary"))


def _unpack(z: pa.Scalar, size: int) -> bytes:
    return pa.decompress(z.as_buffer(), size, "zstd", asbytes=True) if size else b""


def anchor_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per anchor of a text (with its surroundings): document key, position ``a`` of the first, distances ``near`` to
    ``far`` back to the starts it stands for, bucket ``g``, identifier ``u`` of the surroundings, how often the text
    has it (``n``) and, if more than once, the ``runs`` of starts of all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                raws = [(t or "").encode() for t in part.column("_text").to_pylist()]
                high, low = _keys(part.column("_id").to_pylist(), raws)
                for found in anchors(raws):
                    (which, at, near, far, g, u), n, runs = _once_per_text(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(high[which]), pa.array(low[which]), pa.array(at.astype(np.int32)), pa.array(near.astype(np.int32)),
                         pa.array(far.astype(np.int32)), _signed(g), _signed(u), pa.array(n.astype(np.int32)), runs],
                        names=["_id", "_k", "a", "near", "far", "g", "u", "n", "runs"])

    return (docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text).alias("_text"))
            .mapInArrow(run, "_id long, _k long, a int, near int, far int, g long, u long, n int, runs array<struct<lo:int,hi:int>>"))


_CONTEXT = "g long, _id long, _k long, a int, far int, n long, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed texts with their requests: the surroundings of every requested anchor."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in ("_id", "_k", "n_bytes", "z", "wanted")}
            raw = _unpack(row["z"], row["n_bytes"].as_py())
            want = row["wanted"].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["g"] for w in want], pa.int64()), pa.array([row["_id"].as_py()] * len(want), pa.int64()),
                 pa.array([row["_k"].as_py()] * len(want), pa.int64()), pa.array([w["a"] for w in want], pa.int32()),
                 pa.array([w["far"] for w in want], pa.int32()), pa.array([w["n"] for w in want], pa.int64()),
                 pa.array([raw[w["a"] - w["far"]:w["a"] - w["near"] + LENGTH] for w in want], pa.binary())],
                names=["g", "_id", "_k", "a", "far", "n", "context"])


def _start_runs(rows: pa.RecordBatch, context: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Runs of string starts (in their documents) of the given strings of the rows' contexts."""
    order = np.lexsort((offset, context))
    context, offset = context[order], offset[order]
    first, last, owner = [], [], []
    for c in np.unique(context):
        lo, hi = _runs(offset[np.searchsorted(context, c):np.searchsorted(context, c, side="right")])
        shift = rows.column("a")[int(c)].as_py() - rows.column("far")[int(c)].as_py()
        first += (lo + shift).tolist()
        last += (hi + shift).tolist()
        owner += [int(c)] * len(lo)
    take = pa.array(owner, pa.int64())
    return pa.RecordBatch.from_arrays([rows.column("_id").take(take), rows.column("_k").take(take), pa.array(first, pa.int32()),
                                       pa.array(last, pa.int32())], names=["_id", "_k", "lo", "hi"])


def _refine_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by bucket: the starts of strings that occur more than once, for anchors that were alone with
    their surroundings (``n`` = 1); whole buckets are refined together."""
    held: pa.RecordBatch | None = None

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        context, offset = refine(rows.column("context").to_pylist())
        single = rows.column("n").to_numpy()[context] == 1
        return _start_runs(rows, context[single], offset[single])

    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        while batch.num_rows:
            g = batch.column("g").to_numpy()
            ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))  # the last bucket may go on
            cut = ends[:-1][np.searchsorted(ends[:-1], _CONTEXTS):][:1]
            if not len(cut):
                break
            yield work(batch.slice(0, int(cut[0])))
            batch = batch.slice(int(cut[0]))
        held = batch
    if held is not None and held.num_rows:
        yield work(held)


def _all_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of contexts of crowded buckets, with its identifiers and place."""
    for batch in batches:
        for row in batch.to_pylist():
            x, y = _string_ids(row["context"])
            start = np.arange(len(x), dtype=np.int32) + np.int32(row["a"] - row["far"])
            yield pa.RecordBatch.from_arrays(
                [_signed(x), _signed(y), pa.array(np.full(len(x), row["_id"])), pa.array(np.full(len(x), row["_k"])),
                 pa.array(np.full(len(x), row["n"])), pa.array(start)], names=["x", "y", "_id", "_k", "n", "start"])


def repeated_starts(docs: DataFrame, whole: DataFrame, id_col: str, text: str, crowded: int = CROWDED) -> DataFrame:
    """(``_id``, ``_k``, ``lo``, ``hi``): runs of starts of LENGTH-byte strings that also start elsewhere."""
    rows = written(anchor_rows(docs, id_col, text), "suffix-anchors")
    buckets = rows.groupBy("g").agg(F.sum("n").alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1")).filter("n > 1")
    buckets = written(buckets.select("g", (F.col("u0") != F.col("u1")).alias("mixed")), "suffix-buckets")
    shared = written(rows.join(buckets, "g"), "suffix-shared")
    dropped(rows, buckets)

    alone = F.struct((F.col("a") - F.col("far")).alias("lo"), (F.col("a") - F.col("near")).alias("hi"))
    starts = F.inline(F.coalesce("runs", F.array(alone)))
    plain = shared.filter(~F.col("mixed")).select("_id", "_k", starts)
    mixed = shared.filter("mixed")
    classes = mixed.groupBy("g", "u").agg(F.sum("n").alias("n"), F.min(F.struct("_id", "_k", "a", "near", "far")).alias("one"))
    classes = written(classes, "suffix-classes")
    several = mixed.join(classes.filter("n > 1").select("g", "u"), ["g", "u"], "left_semi").select("_id", "_k", starts)

    wanted = (classes.groupBy("one._id", "one._k")
              .agg(F.collect_list(F.struct("g", F.col("one.a"), F.col("one.near"), F.col("one.far"), "n")).alias("wanted")))
    contexts = whole.join(wanted, ["_id", "_k"]).select("_id", "_k", "n_bytes", "z", "wanted").mapInArrow(_contexts, _CONTEXT)
    # repeated rows of docs give a context twice; theirs are classes of several members, which only serve as partners

    many = classes.groupBy("g").count().filter(F.col("count") > crowded).select("g")
    out = plain.unionByName(several)
    if many.isEmpty():
        quiet = contexts
    else:
        many, contexts = written(many, "suffix-crowded"), written(contexts, "suffix-contexts")
        quiet = contexts.join(many, "g", "left_anti")
        strings = contexts.join(many, "g", "left_semi").select(*contexts.columns).mapInArrow(
            _all_strings, "x long, y long, _id long, _k long, n long, start int")
        strings = written(strings, "suffix-strings")
        twice = strings.groupBy("x", "y").count().filter("count > 1").select("x", "y")
        found = strings.filter("n = 1").join(twice, ["x", "y"], "left_semi")
        out = out.unionByName(found.select("_id", "_k", F.col("start").alias("lo"), F.col("start").alias("hi")))
    refined = (quiet.repartition("g").sortWithinPartitions("g").select(*contexts.columns)
               .mapInArrow(_refine_groups, "_id long, _k long, lo int, hi int"))
    return out.unionByName(refined)


def covered(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the LENGTH-byte strings that start in [lo, hi]."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), (hi + LENGTH).tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs) and ``kept`` (the remaining bytes)."""
    whole = packed(docs, id_col, text)
    found = repeated_starts(docs, whole, id_col, text, crowded)
    runs = found.groupBy("_id", "_k").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "z"):
                removed, spans, kept = [], [], []
                for size, z, r in zip(part.column("n_bytes").to_pylist(), part.column("z"), part.column("runs")):
                    raw = _unpack(z, size)
                    cut = covered(r.values.field("lo").to_numpy(), r.values.field("hi").to_numpy()) if r.is_valid else []
                    edges = [0, *(e for c in cut for e in c), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    removed.append(len(raw) - len(kept[-1]))
                    spans.append(len(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                     pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return (whole.join(runs, ["_id", "_k"], "left").select("doc_id", "n_bytes", "z", "runs")
            .mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))
