"""Quality classifier by nearest-neighbour voting in a latent semantic space.

Every whole text becomes a vector of term counts, hashed byte trigrams and words that repeat
the word before them, weighted by log term frequency and the inverse document frequency over all documents, and projected
on the leading singular directions of a bounded sample of labelled rows.  The sample's latent
vectors (bounded by a parameter) are broadcast; each block of documents takes its exact cosine
products with all of them and the nearest ones vote, weighted by similarity.

Defined results: null and empty texts (and texts of under three bytes) have no vector
and get the share of good labels; without labelled rows every score is 0.5; rows that repeat get equal scores;
an empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import add_columns, bounded_labels, free_name

BUCKETS = 2048
#: Repeated words count as this many terms of their own, so that they tell as much as some trigrams do.
REPEAT_TERMS = 8
DIMS = BUCKETS + REPEAT_TERMS
LATENT = 64
#: Bound on the labelled rows whose vectors are broadcast.
SAMPLE_ROWS = 4000
NEIGHBOURS = 25
BLOCK = 512
#: Similarities are raised to this power as voting weights.
SHARPNESS = 8
THRESHOLD = 0.7


def term_counts(text: str | None) -> np.ndarray:
    """Term counts of a whole text: its byte trigrams in BUCKETS hash buckets, then its repeated words."""
    raw = (text or "").encode()
    b = np.frombuffer(raw, np.uint8)
    out = np.zeros(DIMS, np.int64)
    if len(b) < 3:
        return out.astype(np.float32)
    for at in range(0, len(b) - 2, 1 << 20):  # very long texts in runs
        x = b[at:at + (1 << 20) + 2].astype(np.uint32)
        key = (x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(2654435761)
        out[:BUCKETS] += np.bincount(key >> np.uint32(21), minlength=BUCKETS)
    words = raw.split()
    out[BUCKETS:] = sum(map(operator.eq, words, words[1:]))
    return out.astype(np.float32)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents: every
    task adds up its rows, then one small aggregate per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df += term_counts(t.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMS + 1), pa.int32()), pa.array([*df.tolist(), n], pa.int64())],
                                         names=["bucket", "n"])

    rows = (docs.select(F.col(text).alias("_text")).mapInArrow(run, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    total = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        total[r.bucket] = r.n
    return total[:-1], int(total[-1])


@dataclass
class Model:
    """idf weights, projection, unit latent vectors of the sample and their labels."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(counts), prior)
        full = counts.any(axis=1)
        if not len(self.labels) or not full.any():
            return out
        cos = self.latent(counts[full]) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, axis=1).astype(np.float64), 0) ** SHARPNESS
        sums = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        out[full] = np.where(sums > 0, vote / np.maximum(sums, 1e-300), prior)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label_col: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` of ``labels``; document frequencies come from all ``docs``."""
    df, n = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    sample = bounded_labels(labels, sample_rows, id_col, label_col)
    own = (docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
           .join(F.broadcast(sample), "_id").dropDuplicates(["_id"]))
    rows = (add_columns(own, "_text", {"_x": "array<float>"}, lambda: lambda ts: [[term_counts(t) for t in ts]])
            .select("_id", "_label", "_x").orderBy("_id").toArrow())
    empty = Model(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    if not rows.num_rows:
        return empty
    counts = np.concatenate([c.values.to_numpy() for c in rows["_x"].chunks]).reshape(-1, DIMS)
    y = rows["_label"].to_numpy().astype(float)
    full = counts.any(axis=1)
    if not full.any():
        return empty
    x = np.log1p(counts[full]) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # leading right singular vectors by randomised range finding, fixed seed
    q = x.T @ np.random.default_rng(7).standard_normal((len(x), LATENT + 16)).astype(np.float32)
    for _ in range(4):
        q = x.T @ (x @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    model = Model(idf, (q @ vt.T[:, :LATENT]).astype(np.float32), empty.vectors, y[full])
    model.vectors = model.latent(counts[full]).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the score of every whole text; the second value names the column."""
    # bounded: SAMPLE_ROWS x LATENT and DIMS x LATENT floats
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.projection, model.vectors, model.labels))
    name = free_name(docs, "score")

    def make():
        m = Model(*shared.value)

        def run(texts: list) -> list[list]:
            out: list[float] = []
            for at in range(0, len(texts), BLOCK):
                out += m.scores(np.stack([term_counts(t) for t in texts[at:at + BLOCK]])).tolist()
            return [out]
        return run

    return add_columns(docs, text, {name: "double"}, make), name
