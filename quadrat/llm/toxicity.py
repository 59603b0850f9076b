"""Toxicity classifier: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed features: words, pairs of adjacent words, and pairs with one or two
words between. FTRL-proximal keeps a learning rate for each coordinate, and its L1 term leaves most weights
at exactly zero, so that the model is a short list of coordinates and weights.

Training rows are dealt by a hash of their id into shards of about ``SHARD_ROWS`` rows; each shard is trained
by one task with its share of the L1 term. A learner's state is a quadratic function for each coordinate; those of all shards are
added up, and the whole L1 term is applied once to the sums, so that a term counts by how often it occurs in all shards together. At most ``TRAIN_ROWS`` labelled
rows (those with the least hash) are used, which bounds the work and what is added up. Scoring reads every whole text once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.text import WORD_TABLE, append_columns, blobs, hashed_words, mixed, text_slices

BITS = 20
TRAIN_ROWS = 400_000
SHARD_ROWS = 20_000
_PIECE = 1 << 13
_UNIT = 2.0**32
_PAIRS = ((1, 0x8CB92BA72F3D8DD7), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner; ``alpha`` and ``beta`` set the rates, ``l1`` and ``l2`` the penalties."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 3


@dataclass(frozen=True)
class Model:
    """Weights of the coordinates that are not zero, sorted by coordinate."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float64)
        out[self.coordinates] = self.weights
        return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all n-grams and skip-grams, and the text that each belongs to (with repeats)."""
    words, owner = hashed_words(texts, WORD_TABLE)
    shift = np.uint64(64 - BITS)
    coordinates, owners = [words >> shift], [owner]
    for gap, factor in _PAIRS:
        inside = owner[gap:] == owner[:-gap]
        pair = mixed(words[:-gap][inside] * np.uint64(factor) + words[gap:][inside])
        coordinates.append(pair >> shift)
        owners.append(owner[gap:][inside])
    return np.concatenate(coordinates).astype(np.int64), np.concatenate(owners)


def feature_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct coordinates of each text."""
    coordinates, owners = features(texts)
    both = np.unique((owners.astype(np.int64) << BITS) | coordinates)
    cuts = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
    both = (both & ((1 << BITS) - 1)).astype(np.int32)
    return [both[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def train(rows: list[np.ndarray], labels: np.ndarray, settings: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows in the order given: its linear terms and the roots of its sums of squares.

    The bias is the last coordinate and has no L1 term.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, settings.l1)
    l1[size] = 0.0
    a, b, l2 = settings.alpha, settings.beta, settings.l2
    for _ in range(settings.epochs):
        for row, y in zip(rows, labels):
            active = np.append(row, np.int32(size))
            za, na = z[active], n[active]
            root = np.sqrt(na)
            w = -np.sign(za) * np.maximum(np.abs(za) - l1[active], 0.0) / ((b + root) / a + l2)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0)))
            g = p - y
            z[active] = za + g - (np.sqrt(na + g * g) - root) / a * w
            n[active] = na + g * g
    return z, np.sqrt(n)


def solve(z: np.ndarray, root: np.ndarray, l1: float, settings: Ftrl) -> np.ndarray:
    """The weights of the linear terms and roots of one learner, or of the sums over several."""
    return -np.sign(z) * np.maximum(np.abs(z) - l1, 0.0) / ((settings.beta + root) / settings.alpha + settings.l2)


def training_labels(labels: DataFrame, label: str, rows: int, folds: int = 5) -> tuple[DataFrame, int]:
    """At most about ``rows`` labelled ids outside the held-out fold, and how many there are.

    The held-out fold is crc32 of the id as text modulo ``folds`` equal to 0. Labels that are NULL are left out; an id that is
    labelled twice takes the larger label. Beyond ``rows``, the ids with the least hashes are taken.
    """
    known = (
        labels.where(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("__label"))
        .withColumn("__order", F.xxhash64(F.col("doc_id").cast("string"), F.lit(31)))
    )
    count = known.count()
    if count > rows:
        known = known.where(F.col("__order") < int(-(2**63) + 2**64 * (rows / count)))
    return known, min(count, rows)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    text: str = "text",
    settings: Ftrl = Ftrl(),
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """Fit on the labelled documents outside the held-out fold; no labelled rows give a zero model.

    The chosen labels are at most about ``train_rows`` pairs of an id and a number, which is the bound that lets them be broadcast.
    """
    known, count = training_labels(labels, label, train_rows)
    if not count:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0)
    shards = -(-count // SHARD_ROWS)
    rows = documents.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id")

    def fit_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        labels, hashes = [], []
        for batch in text_slices(batches, "text"):
            sets += feature_sets(blobs(batch, "text"))
            labels += batch.column("__label").to_pylist()
            hashes += batch.column("__order").to_pylist()
        # Rows in the order of their hashes; equal ids (repeated rows) in the order of their features.
        often = Counter(hashes)
        order = sorted(range(len(sets)), key=lambda k: (hashes[k], sets[k].tobytes() if often[hashes[k]] > 1 else b""))
        z, root = train([sets[k] for k in order], np.array(labels)[order], replace(settings, l1=settings.l1 / shards))
        for piece in range(-(-len(z) // _PIECE)):
            part = slice(piece * _PIECE, (piece + 1) * _PIECE)
            if root[part].any():
                both = np.round(np.stack([z[part], root[part]]) * _UNIT).astype("<i8")
                yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "sums": pa.array([zlib.compress(both.tobytes(), 1)])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, piece = 0, 0
        for batch in batches:
            for piece, packed in zip(batch.column("piece").to_pylist(), batch.column("sums").to_pylist()):
                total = total + np.frombuffer(zlib.decompress(packed), "<i8").reshape(2, -1)
        z, root = total / _UNIT
        start = piece * _PIECE
        weights = solve(z, root, 0.0 if start == 1 << BITS else settings.l1, settings)  # the bias is a piece of its own
        live = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(start + live), pa.array(weights[live])], ["coordinate", "weight"])

    fitted = (
        rows.withColumn("shard", F.pmod(F.xxhash64("__order"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(fit_shard, "piece int, sums binary")
        .groupBy("piece")
        .applyInArrow(add, "coordinate long, weight double")
        .toPandas()
        .sort_values("coordinate")
    )
    bias = float(fitted.loc[fitted.coordinate == 1 << BITS, "weight"].sum())
    fitted = fitted[fitted.coordinate < 1 << BITS]
    return Model(fitted.coordinate.to_numpy(np.int64), fitted.weight.to_numpy(), bias)


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with a probability of the label in ``name``.

    A NULL or empty text has no features and gets the probability of the bias alone. Repeated rows get the
    same score; other columns stay as they are; an empty table gives an empty one.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        weights = fitted.dense()
        for batch in text_slices(batches, text):
            coordinates, owners = features(blobs(batch, text))
            w = weights[coordinates]
            live = np.flatnonzero(w)
            both = np.unique((owners[live].astype(np.int64) << BITS) | coordinates[live])
            total = np.bincount(both >> BITS, weights[both & ((1 << BITS) - 1)], batch.num_rows) + fitted.bias
            yield append_columns(batch, **{name: pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))))})

    return documents.mapInArrow(run, schema)


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose toxicity is below ``threshold``, with their own columns."""
    scored = score(documents, fit(documents, labels), name="__toxicity")
    return scored.where(F.col("__toxicity") < threshold).select(*[scored[c] for c in documents.columns])
