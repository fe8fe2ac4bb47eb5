"""Alignment of the tokens of two tokenizers over a corpus.

Both tokenizers split the same bytes (a space and the text).  Cumulative byte ends of each side's tokens go into a
dictionary from end to index; the intersection of the two key sets, sorted, holds the offsets where a token ends on
both sides, and these keys slice both id lists into groups.  Within a slice, every token of A and every
token of B that end together are linked (one pair per slice, unless a vocabulary has tokens without bytes).

Counts of linked id pairs are corpus-wide: each document keeps its distinct pairs with their numbers, these are added up
with partial aggregation, and every document's pairs meet the totals again.  The most frequent pairs, at most
HOT of them (a histogram of the totals finds the power of two above which there are no more), are broadcast, which
covers most occurrences and every hot pair; all others meet their totals in an equi join.

Defined results: null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no tokens:
all numbers are 0 and ``groups`` is empty.  Special tokens' strings inside a text are plain text.  Repeated rows and null ids are
rows of their own; ties for a B id's highest count all count as best; an empty table gives an empty result; further
columns are carried along, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import free_name, slices, written

#: Most pairs whose totals are broadcast (about 20 bytes each).
HOT = 500_000
#: Text worked on at once: small enough for its dictionaries to stay in the cache.
BLOCK_BYTES = 1 << 15

#: Fixed value: the pattern by which a byte-level tokenizer splits a text into words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Vocabulary = tuple[Callable[[list[str]], list[list[int]]], list[bytes]]


def byte_level(symbols: str) -> bytes:
    """The bytes of a byte-level vocabulary entry: printable Latin-1 characters stand for themselves,
    the other bytes, in order, for the characters from U+0100."""
    return bytes(map(_BYTE_OF.__getitem__, symbols))


def _byte_of() -> dict[str, int]:
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


_BYTE_OF = _byte_of()


def byte_bpe(serialized: str) -> Vocabulary:
    """Encoder and token bytes of a serialized byte-level tokenizer (JSON).

    Where ids follow the order of the merges (as they do in the public files), the file's entries are the ranks of the same
    tokenizer, and the rank library, which is about five times as fast, gives the same ids; it is left for texts that it can't split."""
    spec = json.loads(serialized)
    vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        token_bytes[i] = byte_level(token)
    models: list = []

    def plain(texts: list[str]) -> list[list[int]]:
        if not models:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            models.append(Tokenizer.from_str(serialized))
            models[0].encode_special_tokens = True  # their strings in a text are ordinary text
        return [e.ids for e in models[0].encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]

    ranks = _ranks(spec)
    if ranks is None:
        return plain, token_bytes
    import tiktoken

    quick = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            try:
                out.append(quick.encode_to_numpy(f" {t}", disallowed_special=()))
            except ValueError:  # its splitter gives up on very long runs of white space
                out += plain([t])
        return out

    return encode, token_bytes


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to id if the tokenizer splits by the common pattern and its ids follow its merges' order."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and spec["normalizer"] is None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(m)) for m in merges]
    singles = sorted(model["vocab"].get(c, -1) for c in _BYTE_OF)
    if not usual or model.get("ignore_merges") or model.get("dropout") or singles != list(range(256)) or ids != list(range(256, 256 + len(ids))):
        return None
    return {byte_level(t): i for t, i in model["vocab"].items() if i < 256 + len(ids)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: U+2581 is a space, ``<0xHH>`` one byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def pieces(serialized: bytes) -> Vocabulary:
    """Encoder and token bytes of a serialized piece model, which puts the space before a text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=serialized)
    return partial(model.encode, num_threads=1), [piece_bytes(model.id_to_piece(i)) for i in range(model.get_piece_size())]


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of A, and how many of B, end at or before each end that both sides have, in order."""
    after_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    after_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(after_a.keys() & after_b.keys())
    return list(map(after_a.__getitem__, common)), list(map(after_b.__getitem__, common))


def slice_links(sizes_a: np.ndarray, sizes_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of A and B that are linked: the last of every slice, and with them the tokens
    without bytes that end at the same place."""
    def tail(sizes: np.ndarray, cut: np.ndarray) -> np.ndarray:
        n, at = np.ones(len(cut), np.int64), cut - 1
        begin = np.append(0, cut[:-1]) if len(cut) else cut
        while True:
            more = (at > begin) & (sizes[at] == 0)
            if not more.any():
                return n
            n, at = n + more, at - more

    n_a, n_b = tail(sizes_a, cut_a), tail(sizes_b, cut_b)
    if (n_a == 1).all() and (n_b == 1).all():
        return cut_a - 1, cut_b - 1
    n = n_a * n_b
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(cut_a, n) - 1 - k // np.repeat(n_b, n), np.repeat(cut_b, n) - 1 - k % np.repeat(n_b, n)


class Aligner:
    """Texts to the columns of FIELDS; all texts of a call are worked on together."""

    def __init__(self, a: Vocabulary, b: Vocabulary) -> None:
        self.sides = a, b
        self.sizes = [np.array(list(map(len, v[1])), np.int64) for v in (a, b)]
        self.starts = [np.cumsum(s) - s for s in self.sizes]
        self.blobs = [np.frombuffer(b"".join(v[1]), np.uint8) for v in (a, b)]
        self.width = [len(v[1]) for v in (a, b)]
        # names of A's ids inside a group and at the end of theirs, then the same of B's, and of B's at the end of a text
        self.names = pa.array([f"{i}{mark}" for n, marks in zip(self.width, ((",", "|"), (",", ";", ""))) for mark in marks for i in range(n)])

    def _given_back(self, side: int, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, joined."""
        size = self.sizes[side][ids]
        ends = np.cumsum(size)
        return self.blobs[side][np.repeat(self.starts[side][ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def tokens(self, texts: list[str | None]) -> tuple[list[int], list[list], list[list]]:
        """Places of the texts that both tokenizers give back byte for byte, and their ids."""
        some = [i for i, t in enumerate(texts) if t]
        raws = [b" " + texts[i].encode() for i in some]
        ids = [[np.array(x, np.int64) for x in encode([texts[i] for i in some])] if some else [] for encode, _ in self.sides]
        if some:
            whole = np.frombuffer(b"".join(raws), np.uint8)
            if not all(np.array_equal(self._given_back(k, np.concatenate(x)), whole) for k, x in enumerate(ids)):
                good = [i for i, raw in enumerate(raws) if all(self._given_back(k, x[i]).tobytes() == raw for k, x in enumerate(ids))]
                some, ids = [some[i] for i in good], [[x[i] for i in good] for x in ids]
        return some, *ids

    def __call__(self, texts: list[str | None]) -> list[pa.Array]:
        place, ids_a, ids_b = self.tokens(texts)
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (ids_a, ids_b))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids_a, ids_b))
        doc_a, doc_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        size_a, size_b = self.sizes[0][a], self.sizes[1][b]
        # both sides of a text have the same bytes; one more for each text keeps their ends apart
        cut_a, cut_b = (np.array(c, np.int64) for c in common_ends((np.cumsum(size_a) + doc_a).tolist(), (np.cumsum(size_b) + doc_b).tolist()))
        group_doc = doc_a[cut_a - 1]
        groups = self._groups(a, b, cut_a, cut_b, np.cumsum(n_a + n_b))
        at_a, at_b = slice_links(size_a, size_b, cut_a, cut_b)
        link_doc = doc_a[at_a]
        found, times = np.unique((link_doc * self.width[0] + a[at_a]) * self.width[1] + b[at_b], return_counts=True)
        rest, pair_b = np.divmod(found, self.width[1])
        pair_doc, pair_a = np.divmod(rest, self.width[0])

        def numbers(per_doc: np.ndarray) -> np.ndarray:
            out = np.zeros(len(texts), np.int64)
            out[place] = per_doc
            return out

        count = lambda docs: np.bincount(docs, minlength=len(place))
        at = np.full(len(texts), -1)
        at[place] = np.arange(len(place))
        texts_out = pc.fill_null(groups.take(pa.array(at, mask=at < 0)), "")
        offsets = pa.array(np.append(0, np.cumsum(numbers(count(pair_doc)))).astype(np.int32))
        return [pa.array(numbers(n_a)), pa.array(numbers(n_b)), pa.array(numbers(count(group_doc))), pa.array(numbers(count(link_doc))),
                texts_out, pa.ListArray.from_arrays(offsets, pa.array(pair_a << 32 | pair_b)),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]

    def _groups(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, ends: np.ndarray) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of every text, whose tokens of both sides end at ``ends``."""
        width_a, width_b = self.width
        group_a, group_b = (np.repeat(np.arange(len(c)), np.diff(c, prepend=0)) for c in (cut_a, cut_b))
        name = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cut_a - 1] = last_b[cut_b - 1] = True
        name[np.arange(len(a)) + np.append(0, cut_b)[group_a]] = a + width_a * last_a
        name[np.arange(len(b)) + cut_a[group_b]] = b + width_b * last_b + 2 * width_a
        name[ends - 1] += width_b
        named = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), self.names.take(pa.array(name)))
        return pc.binary_join(named, "")


FIELDS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "pairs": "array<long>", "pair_n": "array<int>"}


def aligned(docs: DataFrame, a: str, b: bytes, text: str = "text", keep_text: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (without the text, unless ``keep_text``) with the alignment of each whole text by the serialized tokenizers ``a``
    (:func:`byte_bpe`) and ``b`` (:func:`pieces`), which are broadcast.  The second value names the columns of FIELDS: numbers of tokens,
    groups and links, the groups (``a1,a2|b1;a3|b2,b3``), and the distinct linked pairs (A id * 2**32 + B id) with their numbers."""
    models = docs.sparkSession.sparkContext.broadcast((a, b))
    names = {field: free_name(docs, field) for field in FIELDS}
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(names[f], T.StructType.fromDDL(f"x {k}")[0].dataType) for f, k in FIELDS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_a, model_b = models.value
        align = Aligner(byte_bpe(model_a), pieces(model_b))
        for batch in batches:
            for part in slices(batch, text, BLOCK_BYTES):
                made = align(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, names=[*kept, *names.values()])

    return docs.mapInArrow(run, schema), names


def pair_totals(rows: DataFrame, pairs: str = "pairs", pair_n: str = "pair_n") -> DataFrame:
    """(``pair``, ``total``, ``best``): how many links of all rows hold each id pair, and whether that is its B id's highest total."""
    each = rows.select(F.inline(F.arrays_zip(F.col(pairs).alias("pair"), F.col(pair_n).alias("n"))))
    totals = written(each.groupBy("pair").agg(F.sum(F.col("n").cast("long")).alias("total")), "align-totals")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    highest = totals.groupBy(b).agg(F.max("total").alias("highest"))  # a row for each id of a vocabulary at most
    return totals.withColumn("b", b).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def _hot_from(totals: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` totals reach."""
    steps = {r[0]: r[1] for r in totals.groupBy(F.length(F.bin("total"))).count().collect()}
    above, low = 0, 64
    while low > 1 and above + steps.get(low - 1, 0) <= most:
        low -= 1
        above += steps.get(low, 0)
    return 1 << min(low - 1, 62)


def corpus_counts(rows: DataFrame, row: str, pairs: str = "pairs", pair_n: str = "pair_n", hot: int = HOT) -> DataFrame:
    """(``row``, ``n_best``, ``count_sum``) for rows with pairs: links whose pair's total is its B id's highest, and the sum of the totals
    over all links.  Totals are of all ``rows``, which are read several times and should be a written table."""
    totals = written(pair_totals(rows, pairs, pair_n), "align-best")
    least = _hot_from(totals, hot)
    each = rows.select(row, F.inline(F.arrays_zip(F.col(pairs).alias("pair"), F.col(pair_n).alias("n"))))
    frequent = F.broadcast(totals.filter(F.col("total") >= least))  # at most ``hot`` rows
    sums = [F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum")]
    met = each.join(frequent, "pair").groupBy(row).agg(*sums)
    rare = each.join(frequent.select("pair"), "pair", "left_anti").join(totals.filter(F.col("total") < least), "pair").groupBy(row).agg(*sums)
    return met.unionByName(rare).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
