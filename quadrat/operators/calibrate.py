"""One-vs-rest sigmoid calibration fitted from a probability table.

For class k the model is p = 1 / (1 + exp(a*f + b)) on the class's own probability f, with the
usual prior-smoothed targets. All classes take their Newton step in the same pass: each task adds up its rows' K
gradients and Hessians in numpy, batch by batch, and returns one row per class; only the 2K parameters live on
the driver. No row is unfolded over the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.numbers import normalised
from quadrat.operators.staging import stage

STEPS = 100
TOLERANCE = 1e-9
_RIDGE = 1e-12
_SUMS = ("loss", "ga", "gb", "haa", "hab", "hbb")


class NotConverged(RuntimeError):
    """A class's parameters still move after the last step."""


def _columns(probs: np.ndarray, gt: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, problems) of scores and of hits: two classes are one problem, on the second class."""
    hits = gt[:, None] == np.arange(n_classes)
    return (probs[:, 1:], hits[:, 1:]) if n_classes == 2 else (probs, hits)


def _batches(batches: Iterator[pa.RecordBatch], n_classes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("proba").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            gt = batch.column("gt_idx").to_numpy(zero_copy_only=False)
            yield _columns(flat.reshape(batch.num_rows, n_classes), gt, n_classes)


def _totals(rows: DataFrame, run, names: tuple[str, ...], size: int) -> np.ndarray:
    """(problems, sums) of a pass in which each task returns one row per problem."""
    schema = "k int, " + ", ".join(f"{n} double" for n in names)
    sums = rows.mapInArrow(run, schema).groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = np.zeros((size, len(names)))
    for r in sums:
        out[r["k"]] = [r[n] for n in names]
    return out


def _table(sums: np.ndarray, names: tuple[str, ...]) -> pa.RecordBatch:
    columns = [pa.array(np.arange(len(sums), dtype=np.int32)), *[pa.array(c) for c in sums.T]]
    return pa.RecordBatch.from_arrays(columns, ["k", *names])


def fit_sigmoids(probs: DataFrame, n_classes: int, steps: int = STEPS) -> DataFrame:
    """(k, a, b, steps, converged) from (gt_idx, proba) rows of the reference split.

    Raises ``NotConverged`` when a class needs more than ``steps`` passes. With two classes the one row is that of class 1.
    """
    rows = stage(probs.select("gt_idx", "proba"), "calibration")
    size = 1 if n_classes == 2 else n_classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 2))
        for _, hits in _batches(batches, n_classes):
            total += np.stack([hits.sum(axis=0), (~hits).sum(axis=0)], axis=1)
        yield _table(total, ("pos", "neg"))

    pos, neg = _totals(rows, count, ("pos", "neg"), size).T
    high, low = (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0)
    a, b = np.zeros(size), np.log((neg + 1.0) / (pos + 1.0))
    trial_a, trial_b = a.copy(), b.copy()
    step_a, step_b, slope = np.zeros(size), np.zeros(size), np.zeros(size)
    rate, loss = np.ones(size), np.full(size, np.inf)
    taken, active = np.zeros(size, dtype=int), np.ones(size, dtype=bool)
    for step in range(steps):
        sums = _sums(rows, n_classes, size, trial_a, trial_b, high, low)
        for k in np.flatnonzero(active):
            got, ga, gb, haa, hab, hbb = sums[k]
            if got > loss[k] + 1e-4 * slope[k] * rate[k]:
                # The step overshot: halve it and look again.
                rate[k] /= 2
                if rate[k] < 1e-10:  # the loss no longer changes in double precision
                    active[k] = False
                    continue
                trial_a[k], trial_b[k] = a[k] + rate[k] * step_a[k], b[k] + rate[k] * step_b[k]
                continue
            a[k], b[k], loss[k], taken[k] = trial_a[k], trial_b[k], got, step
            if max(abs(ga), abs(gb)) < TOLERANCE * max(1.0, pos[k] + neg[k]):
                active[k] = False
                continue
            hessian = np.array([[haa + _RIDGE, hab], [hab, hbb + _RIDGE]])
            step_a[k], step_b[k] = -np.linalg.solve(hessian, [ga, gb])
            slope[k], rate[k] = ga * step_a[k] + gb * step_b[k], 1.0
            trial_a[k], trial_b[k] = a[k] + step_a[k], b[k] + step_b[k]
        if not active.any():
            break
    if active.any():
        raise NotConverged(f"Classes {np.flatnonzero(active).tolist()} are not settled after {steps} steps.")
    first = 1 if n_classes == 2 else 0
    table = [(first + k, float(a[k]), float(b[k]), int(taken[k]), True) for k in range(size)]
    return probs.sparkSession.createDataFrame(table, "k int, a double, b double, steps int, converged boolean")


def _sums(rows: DataFrame, n_classes: int, size: int, a, b, high, low) -> np.ndarray:
    """Loss, gradient and Hessian sums of each class at its trial parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, len(_SUMS)))
        for f, hits in _batches(batches, n_classes):
            z = a * f + b
            target = np.where(hits, high, low)
            p = 1.0 / (1.0 + np.exp(np.clip(z, -700.0, 700.0)))
            d, w = target - p, p * (1.0 - p)
            # -t ln p - (1 - t) ln(1 - p), with ln p = -ln(1 + e^z) and ln(1 - p) = -ln(1 + e^-z)
            loss = target * np.logaddexp(0.0, z) + (1.0 - target) * np.logaddexp(0.0, -z)
            total += np.stack([x.sum(axis=0) for x in (loss, d * f, d, w * f * f, w * f, w)], axis=1)
        yield _table(total, _SUMS)

    return _totals(rows, run, _SUMS, size)


def apply_sigmoids(probs: DataFrame, fitted: DataFrame) -> DataFrame:
    """Calibrated and row-normalised probabilities; of two classes the second is calibrated and the first is its complement."""
    pairs = [(r["a"], r["b"]) for r in fitted.orderBy("k").collect()]

    def lifted(p, a, b):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(a * p + b))

    if len(pairs) == 1:
        second = lifted(F.get("proba", F.lit(1)), F.lit(pairs[0][0]), F.lit(pairs[0][1]))
        return probs.withColumn("proba", F.array(F.lit(1.0) - second, second))
    a, b = F.array(*[F.lit(x) for x, _ in pairs]), F.array(*[F.lit(y) for _, y in pairs])
    every = F.transform("proba", lambda p, i: lifted(p, F.get(a, i), F.get(b, i)))
    return probs.withColumn("proba", normalised(every))
