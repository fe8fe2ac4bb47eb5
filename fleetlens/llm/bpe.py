"""Byte-level BPE by corpus-level merge replay.

Each block of documents (about BLOCK_BYTES) is split into pattern matches (words); the distinct ones not met before by
the task form one corpus of byte symbols.  An inverted index leads from each mergeable pair (by the
rank of its merged token) to its positions; the merges are replayed in rank order over all
words at once, each on all its positions, and a merge only updates the two neighbours it touches.  Words do not
interact, so the result for a word is that of encoding it alone.

A merge whose token can take part in a pair of lower rank (some vocabularies have such) is replayed position by
position instead, so that the lower pair goes first; pairs that overlap are taken from the left.

Defined results: null and empty texts have no ids and decode to nothing; words of any
length are encoded whole; every byte string can be encoded if the vocabulary holds the 256 single bytes; rows that repeat
get equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlens.llm.common import free_name, slices

#: Distinct words whose ids a task keeps for its later blocks.
KEPT_WORDS = 300_000
#: Text of a block.
BLOCK_BYTES = 4 << 20
#: Merges of fewer positions are replayed one by one: an array operation costs more than they do.
_FEW = 6


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a vocabulary file (a base64 token and its rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_tables(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """What a replay looks up, as arrays of the vocabulary's size: ids of the single bytes, mergeable
    pairs (left id * 2**20 + right id, sorted) with their merged ids, and which tokens may be followed by a lower rank."""
    pairs, merged, risky = [], [], set()
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pairs.append(a << 20 | b)
                merged.append(rank)
                risky.update(x for x in (a, b) if x > rank)
    order = np.argsort(np.array(pairs, np.int64))
    return {"single": np.array([ranks[bytes([b])] for b in range(256)], np.int32), "pairs": np.array(pairs, np.int64)[order],
            "merged": np.array(merged, np.int32)[order], "risky": np.array(sorted(risky), np.int32)}


class Merger:
    """Replays the merges of a vocabulary over a list of words."""

    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        self.single = tables["single"]
        self.pairs = np.append(tables["pairs"], np.iinfo(np.int64).max)
        self.merged = np.append(tables["merged"], -1)
        self.risky = set(tables["risky"].tolist())

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids of pairs of ids, -1 where there is none."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = len(raw)
        self.sym = sym = self.single[raw]
        self.nxt = nxt = np.arange(1, n + 1, dtype=np.int32)
        self.prv = prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[(ends - np.diff(ends, prepend=0))] = -1
        # rank of the pair that starts at each position; an entry of the index is out of date when this has changed
        self.now = now = np.full(n, -1, np.int32)
        at = np.flatnonzero(nxt >= 0)
        now[at] = self._rank(sym[at], sym[at + 1])
        self.index: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self._add(at, now[at])
        while self.heap:
            r = heapq.heappop(self.heap)
            lists = self.index.pop(r, None)
            if lists is None:
                continue
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[now[at] == r]
            if not len(at):
                continue
            if len(lists) > 1:
                at = np.unique(at)
            if len(at) <= _FEW or not self._together(r, at):
                self._one_by_one(r, at.tolist())
        kept = sym >= 0
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        return sym[kept], np.bincount(word[kept], minlength=len(words))

    def _add(self, at: np.ndarray, rank: np.ndarray) -> None:
        """Enter positions into the index under their ranks."""
        good = rank >= 0
        at, rank = at[good], rank[good]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.append(0, cut)].tolist(), np.split(at, cut) if len(cut) else [at]):
            if r in self.index:
                self.index[r].append(part)
            else:
                self.index[r] = [part]
                heapq.heappush(self.heap, r)

    def _together(self, r: int, at: np.ndarray) -> bool:
        """Merge all positions ``at`` (sorted); of overlapping pairs, every second from the left.  Does
        nothing and returns False if one of the merges brings up a pair of lower rank."""
        sym, nxt, prv, now = self.sym, self.nxt, self.prv, self.now
        touch = np.append(False, nxt[at[:-1]] == at[1:])
        if touch.any():
            start = np.maximum.accumulate(np.where(touch, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        has = after >= 0
        if r in self.risky:  # from left to right, a merge meets merged tokens on its left and the old ones on its right
            before = prv[at]
            met = np.append(False, gone[:-1] == before[1:]) & (before >= 0)
            left = np.where(met, r, sym[before])[before >= 0]
            ranks = np.concatenate([self._rank(np.full(has.sum(), r), sym[after[has]]), self._rank(left, np.full(len(left), r))])
            if ((ranks >= 0) & (ranks < r)).any():
                return False
        sym[at], sym[gone], now[gone] = r, -1, -1
        nxt[at] = after
        prv[after[has]] = at[has]
        right, left = at[has], prv[at]
        left = left[left >= 0]
        left = left[sym[left] != r]  # a neighbour merged as well has this pair on its right
        now[at[~has]] = -1
        new = np.concatenate([right, left])
        rank = self._rank(sym[new], sym[nxt[new]])
        now[new] = rank
        # a neighbour that already was the same token is found from the left side, too
        same = prv[at]
        same = same[same >= 0]
        same = same[(sym[same] == r)]
        if len(same):
            rank2 = self._rank(sym[same], sym[nxt[same]])
            now[same] = rank2
            new, rank = np.concatenate([new, same]), np.concatenate([rank, rank2])
        self._add(new, rank)
        return True

    def _one_by_one(self, r: int, at: list[int]) -> None:
        sym, nxt, prv, now = self.sym, self.nxt, self.prv, self.now
        for k, i in enumerate(at):
            if now[i] != r:
                continue  # an earlier merge took one of the two
            gone = nxt[i]
            after = nxt[gone]
            sym[i], sym[gone], now[gone], now[i] = r, -1, -1, -1
            nxt[i] = after
            lower = False
            starts = []
            if after >= 0:
                prv[after] = i
                starts.append(i)
            if prv[i] >= 0:
                starts.append(int(prv[i]))
            for p in starts:
                key = int(sym[p]) << 20 | int(sym[nxt[p]])
                j = int(self.pairs.searchsorted(key))
                s = now[p] = int(self.merged[j]) if self.pairs[j] == key else -1
                if s >= 0:
                    if s in self.index:
                        self.index[s].append(np.array([p]))
                    else:
                        self.index[s] = [np.array([p])]
                        heapq.heappush(self.heap, s)
                    lower |= s < r
            if lower and k + 1 < len(at):  # a lower rank has come up: it goes first
                if r in self.index:
                    self.index[r].append(np.array(at[k + 1:]))
                else:
                    self.index[r] = [np.array(at[k + 1:])]
                    heapq.heappush(self.heap, r)
                return


class Encoder:
    """Texts to ids; keeps the ids of up to KEPT_WORDS distinct words between blocks."""

    def __init__(self, tables: dict[str, np.ndarray], pattern: str) -> None:
        self.merger, self.split = Merger(tables), regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > KEPT_WORDS:
            self._forget()
        number, known = self.number, len(self.number)
        rows = []
        for t in texts:
            words = self.split(t) if t else []
            for w in words:
                if w not in number:
                    number[w] = len(number)
            rows.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        if len(number) > known:
            ids, count = self.merger.replay([w.encode() for w in itertools.islice(number, known, None)])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
        begin = np.cumsum(self.count) - self.count
        out = []
        for row in rows:
            n = self.count[row]
            at = np.repeat(begin[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(self.ids[at])
        return out


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_text: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with the token ids of each whole text (and, unless ``keep_text``, without the
    text); the second value names the ids' column.  Tables of the vocabulary's size are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(merge_tables(ranks))
    name = free_name(docs, "ids")
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, text, BLOCK_BYTES):
                ids = encoder.encode(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [_lists(ids)], names=[*kept, name])

    return docs.mapInArrow(run, schema), name


def decoded(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", keep_ids: bool = True) -> tuple[DataFrame, str, str]:
    """``rows`` with the bytes that the ids stand for (null ids: nothing) and the lowercase hex SHA-256 of the ids as
    little-endian unsigned 32-bit integers, in one pass; the second and third value name the columns."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    shared = rows.sparkSession.sparkContext.broadcast(tokens)
    name, digest = free_name(rows, "decoded"), free_name(rows, "ids_sha256")
    kept = [c for c in rows.columns if keep_ids or c != ids]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(name, T.BinaryType()), T.StructField(digest, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw, sums = [], []
                for v in part.column(ids):
                    x = v.values.to_numpy() if v.is_valid else np.zeros(0, np.int32)
                    raw.append(b"".join(map(token, x.tolist())))
                    sums.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(raw, pa.binary()), pa.array(sums, pa.string())],
                                                 names=[*kept, name, digest])

    return rows.mapInArrow(run, schema), name, digest
