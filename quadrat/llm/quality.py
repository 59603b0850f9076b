"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing gives every token a sparse random index vector (``SIGNS`` entries of 1 or -1); a token's word vector is the sum of the
index vectors of its neighbours in all documents. Tokens share ``BUCKETS`` rows by hash, so the table has a fixed size however large
the vocabulary is. Tokens are runs of letters and digits, and runs of other visible characters. A document is pooled as the mean and the
spread of its tokens' vectors, with frequent tokens weighed down, how alike the vectors of neighbours are, and its length.

The network (tanh hidden layer, logistic output) is trained in numpy on at most ``TRAIN_ROWS`` labelled documents; its logits are then
divided by a temperature fitted on rows that it was not trained on, so that scores are calibrated probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.text import append_columns, blobs, hashed_words, mixed, text_slices
from quadrat.llm.toxicity import training_labels

BITS = 14
BUCKETS = 1 << BITS
DIMENSIONS = 32
SIGNS = 4
REACH = 2
TRAIN_ROWS = 100_000
_CHUNKS = 64
_MARKS = re.compile(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")
_PLAIN = bytes(32 if c < 33 or c == 127 else c for c in range(256))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and the text it belongs to."""
    return hashed_words([_MARKS.sub(rb" \g<0> ", t) for t in texts], _PLAIN)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def context_sums(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """(BUCKETS, DIMENSIONS + 1): sums of the neighbours' index vectors, and the number of tokens."""
    bucket = bucket_of(hashes)
    out = np.zeros((BUCKETS, DIMENSIONS + 1))
    out[:, -1] = np.bincount(bucket, minlength=BUCKETS)
    places, signs = [], []
    for k in range(SIGNS):
        h = mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        places.append((h % np.uint64(DIMENSIONS)).astype(np.int64))
        signs.append(np.where(h >> np.uint64(63), 1.0, -1.0))
    flat = np.zeros(BUCKETS * DIMENSIONS)
    for gap in range(1, REACH + 1):
        inside = np.flatnonzero(owners[gap:] == owners[:-gap])
        for a, b in ((inside, inside + gap), (inside + gap, inside)):
            row = bucket[a] * DIMENSIONS
            for place, sign in zip(places, signs):
                flat += np.bincount(row + place[b], sign[b], len(flat))
    out[:, :-1] = flat.reshape(BUCKETS, DIMENSIONS)
    return out


def word_vectors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the buckets, and their weights: near 1 for rare tokens, less for frequent ones."""
    counts = sums[:, -1]
    vectors = sums[:, :-1] / np.maximum(counts, 1.0)[:, None]
    total = counts.sum()
    if total:
        vectors = vectors - (counts @ vectors) / total
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.where(norms > 1e-12, norms, 1.0)
    return vectors, 1e-3 / (1e-3 + counts / max(total, 1.0))


def pool(texts: list[bytes], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(texts, 2 * DIMENSIONS + 2): weighed mean and spread of the token vectors, likeness of neighbours, log of the length.

    No tokens give zeros.
    """
    hashes, owners = tokens(texts)
    out = np.zeros((len(texts), 2 * DIMENSIONS + 2))
    if not len(hashes):
        return out
    bucket = bucket_of(hashes)
    present, starts = np.unique(owners, return_index=True)
    w = weights[bucket]
    total = np.add.reduceat(w, starts)[:, None]
    weighed = vectors * weights[:, None]
    squares = vectors * weighed
    mean = np.add.reduceat(weighed[bucket], starts, axis=0) / total
    spread = np.add.reduceat(squares[bucket], starts, axis=0) / total - mean * mean
    out[present, :DIMENSIONS] = mean
    out[present, DIMENSIONS:-2] = np.sqrt(np.maximum(spread, 0.0))
    pairs = np.flatnonzero(owners[1:] == owners[:-1])
    alike = np.einsum("ij,ij->i", vectors[bucket[pairs]], vectors[bucket[pairs + 1]])
    count = np.bincount(owners[pairs], minlength=len(texts))
    out[:, -2] = np.bincount(owners[pairs], alike, len(texts)) / np.maximum(count, 1)
    out[present, -1] = np.log1p(np.bincount(owners, minlength=len(texts))[present])
    return out


def standard(inputs: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Inputs in units of their spread, within 4 of them, as texts of a few words reach far beyond the others."""
    return np.clip((inputs - centre) / scale, -4.0, 4.0)


@dataclass(frozen=True)
class Network:
    """Centre and scale of the inputs, two layers and the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        hidden = np.tanh(standard(inputs, self.centre, self.scale) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(inputs) / self.temperature, -35.0, 35.0)))


def train(
    inputs: np.ndarray, labels: np.ndarray, hidden: int = 48, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3
) -> Network:
    """Adam on the logistic loss; every fifth row is left for the temperature."""
    held = np.arange(len(labels)) % 5 == 4
    x, y = inputs[~held], labels[~held]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = standard(x, centre, scale)
    rng = np.random.default_rng(11)
    p = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)),
        np.zeros(hidden),
        rng.normal(0, 1 / np.sqrt(hidden), hidden),
        np.zeros(1),
    ]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    size = min(256, max(16, len(y) // 50))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        step = rate * (1 - epoch / epochs) + 1e-5
        for start in range(0, len(y), size):
            rows = order[start : start + size]
            a = x[rows]
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -35, 35))) - y[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [a.T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] = p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    network = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))
    if not held.any():
        return network
    return Network(*list(vars(network).values())[:-1], fit_temperature(network.logits(inputs[held]), labels[held]))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least logistic loss, searched from 1/2 to 10."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    low, high = -np.log(2.0), np.log(10.0)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def gather_context(documents: DataFrame, text: str = "text") -> np.ndarray:
    """``context_sums`` of all documents: each task adds up its own, and pieces of the tables are added up across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in text_slices(batches, text):
            sums = context_sums(*tokens(blobs(batch, text)))
            total = sums if total is None else total + sums
        if total is not None:
            yield _pieces(total)

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_py(), np.float64) for b in table.column("sums")]
        return pa.table({"chunk": table.column("chunk")[:1], "sums": pa.array([sum(parts).tobytes()], pa.binary())})

    def _pieces(total: np.ndarray) -> pa.RecordBatch:
        pieces = [p.tobytes() for p in np.split(total, _CHUNKS)]
        return pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(pieces, pa.binary())], ["chunk", "sums"])

    schema = "chunk int, sums binary"
    parts = documents.select(text).mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    out = np.zeros((_CHUNKS, BUCKETS // _CHUNKS, DIMENSIONS + 1))
    for part in parts:
        out[part.chunk] = np.frombuffer(part.sums, np.float64).reshape(out.shape[1:])
    return out.reshape(BUCKETS, DIMENSIONS + 1)


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    network: Network | None
    rate: float  # share of good rows where there is no network

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.rate)
        return self.network.scores(pool(texts, self.vectors, self.weights))


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", train_rows: int = TRAIN_ROWS
) -> Model:
    """Word vectors of all documents, and a network fitted on the labelled ones outside the held-out fold.

    At most about ``train_rows`` labels are used, which bounds what is broadcast and the pooled rows that come to the driver. Fewer than ten
    rows or labels of one kind give their smoothed share as every score.
    """
    vectors, weights = word_vectors(gather_context(documents, text))
    known, _ = training_labels(labels, label, train_rows)
    shared = documents.sparkSession.sparkContext.broadcast((vectors, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = shared.value
        for batch in text_slices(batches, "text"):
            pooled = pool(blobs(batch, "text"), v, w).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__order"), batch.column("__label"), pa.array([r.tobytes() for r in pooled], pa.binary())],
                ["order", "label", "pooled"],
            )

    rows = documents.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    drawn = rows.select("__order", "__label", "text").mapInArrow(run, "order long, label double, pooled binary").toArrow()
    drawn = drawn.sort_by([("order", "ascending"), ("pooled", "ascending")])
    y = drawn.column("label").to_numpy()
    if len(y) < 10 or len(np.unique(y)) < 2:
        return Model(vectors, weights, None, float((y.sum() + 1) / (len(y) + 2)))
    x = np.frombuffer(b"".join(drawn.column("pooled").to_pylist()), np.float32).reshape(len(y), -1).astype(np.float64)
    return Model(vectors, weights, train(x, y), float(y.mean()))


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with a calibrated probability of good quality in ``name``.

    A NULL or empty text is pooled to zeros and scored as such. Repeated rows get the same score; other columns stay as they are;
    an empty table gives an empty one.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in text_slices(batches, text):
            yield append_columns(batch, **{name: pa.array(fitted.scores(blobs(batch, text)), pa.float64())})

    return documents.mapInArrow(run, schema)
