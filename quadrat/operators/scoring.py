"""Scoring feature vectors with a calibrated dense head, and checks on probability tables."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quadrat.functions.numbers import argmax, array_total, max_abs_difference, normalised

logger = logging.getLogger(__name__)

# Overshoot that is set to 1, drift of row sums that is worth a warning, parity limit.
OVERSHOOT = 1e-5
ROW_SUM_DRIFT = 1e-4
PARITY_LIMIT = 1e-6

# A head is given by the caller and broadcast whole; it does not grow with the data, and this is its bound.
HEAD_BYTES = 512 << 20


@dataclass(frozen=True)
class Head:
    """Dense layers (ReLU between them) and the per-class sigmoid parameters ``a`` and ``b``."""

    weights: Sequence[np.ndarray]
    biases: Sequence[np.ndarray]
    a: np.ndarray
    b: np.ndarray
    classes: Sequence[str]

    def __post_init__(self) -> None:
        layers, k = len(self.weights), len(self.classes)
        outputs = np.shape(self.weights[-1])[0] if layers else 0
        wrong = {
            "no layer": layers == 0,
            f"{layers} weights and {len(self.biases)} biases": layers != len(self.biases),
            f"{outputs} outputs for {k} classes": outputs != k,
            f"sigmoid parameters of shapes {np.shape(self.a)} and {np.shape(self.b)} for {k} classes": {np.shape(self.a), np.shape(self.b)} != {(k,)},
        }
        found = [what for what, is_so in wrong.items() if is_so]
        if found:
            raise ValueError(f"Not a head: {'; '.join(found)}.")
        size = sum(np.asarray(w).nbytes for w in (*self.weights, *self.biases))
        if size > HEAD_BYTES:
            raise ValueError(f"A head of {size} bytes is too large to go to every task; the bound is {HEAD_BYTES}.")

    @property
    def input_dim(self) -> int:
        return int(np.shape(self.weights[0])[1])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of a batch (rows are samples)."""
        for i, (w, bias) in enumerate(zip(self.weights, self.biases)):
            x = x @ np.asarray(w).T + bias
            if i < len(self.weights) - 1:
                x = np.maximum(x, 0.0)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        c = 1.0 / (1.0 + np.exp(self.a * p + self.b))
        total = c.sum(axis=1, keepdims=True)
        out = np.divide(c, total, out=np.full_like(c, 1.0 / c.shape[1]), where=total != 0)
        out[(out > 1.0) & (out <= 1.0 + OVERSHOOT)] = 1.0
        return out


def require_dimension(features: DataFrame, head: Head, column: str = "features") -> None:
    bad = features.where(F.size(column) != head.input_dim).limit(1).collect()
    if bad:
        raise ValueError(f"features must have {head.input_dim} values; got {len(bad[0][column])}.")


def matrix(vectors: pa.Array, inputs: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of doubles; one of another length, or a NULL, is an error."""
    sizes = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if sizes not in ([], [inputs]):
        raise ValueError(f"features must have {inputs} values; got {sizes}.")
    # The vectors of a batch lie one after another in memory: no value becomes an object.
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(len(vectors), inputs)


def score(features: DataFrame, head: Head, column: str = "features") -> DataFrame:
    """Replace the feature column by ``proba``. A vector of another length fails the task."""
    model = features.sparkSession.sparkContext.broadcast(head)
    kept = [c for c in features.columns if c != column]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = model.value
        for batch in batches:
            proba = head.predict(matrix(batch.column(column), head.input_dim))
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * proba.shape[1])
            scored = pa.ListArray.from_arrays(ends, pa.array(proba.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [scored], names=[*kept, "proba"]
            )

    schema = StructType(
        [f for f in features.schema if f.name != column] + [StructField("proba", ArrayType(DoubleType()))]
    )
    return features.select(*kept, column).mapInArrow(apply, schema)


def renormalised(probs: DataFrame) -> DataFrame:
    """Divide each probability row by its sum."""
    return probs.withColumn("proba", normalised(F.col("proba")))


def row_sum_drift(probs: DataFrame) -> DataFrame:
    """One row: the largest distance of a row sum from 1, and whether it is beyond rounding."""
    drift = F.max(F.abs(array_total(F.col("proba")) - 1))
    return probs.agg(drift.alias("max_drift")).withColumn("suspicious", F.col("max_drift") > ROW_SUM_DRIFT)


def warn_on_drift(probs: DataFrame) -> float | None:
    one = row_sum_drift(probs).first()
    if one["suspicious"]:
        logger.warning("probability row sums deviate from 1 by up to %.2e", one["max_drift"])
    return one["max_drift"]


def top_label(probs: DataFrame, classes: DataFrame) -> DataFrame:
    """Add ``est`` (class key of the most probable class) and ``score`` (its probability)."""
    named = probs.withColumn("est_idx", argmax(F.col("proba"))).withColumn("score", F.array_max("proba"))
    lookup = classes.select(F.col("idx").alias("est_idx"), F.col("class_id").alias("est"))
    return named.join(lookup, "est_idx")


def top_labels(probs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Long table of each sample's ``n`` most probable classes: rank, label, score.

    The ranking is done inside each row's array, so the table is not shuffled.
    """
    indexed = F.transform("proba", lambda p, i: F.struct((-p).alias("neg"), i.alias("idx")))
    best = F.slice(F.array_sort(indexed), 1, n)
    rest = [c for c in probs.columns if c != "proba"]
    long = probs.select(*rest, F.posexplode(best).alias("_pos", "_top"))
    lookup = classes.select("idx", F.col("class_id").alias("label"))
    return (
        long.select(
            *rest,
            (F.col("_pos") + 1).alias("rank"),
            F.col("_top.idx").alias("idx"),
            (-F.col("_top.neg")).alias("score"),
        )
        .join(lookup, "idx")
        .select(*rest, "rank", "label", "score")
    )


def parity(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: samples compared and the largest probability difference, with the verdict."""
    right = b.select(*key, F.col("proba").alias("_other"))
    gap = max_abs_difference(F.col("proba"), F.col("_other"))
    one = a.select(*key, "proba").join(right, list(key)).agg(
        F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_abs_diff")
    )
    return one.withColumn("passed", F.coalesce(F.col("max_abs_diff") <= PARITY_LIMIT, F.lit(False)))


def require_parity(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    result = parity(a, b, key)
    one = result.first()
    if not one["passed"]:
        raise ValueError(f"Probability tables differ by up to {one['max_abs_diff']}.")
    return result
