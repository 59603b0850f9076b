"""Training of a dense head by epochs: mini-batches, a log row for each epoch, stop by validation loss.

Training rows are written once, dealt by a hash of their key into shards, which are folders of that table. A mini-batch is a few
shards, chosen anew in each epoch, so a step reads the rows of its batch only (the scan is pruned to their folders). Each
task adds up the gradient of its rows, the sums meet piece by piece, and the driver, which holds nothing but the parameters,
takes the step. Reference and validation rows are written once too, and scored in one scan after each epoch; accuracy and
loss are aggregates, so that no prediction is kept.

Sums of floating-point numbers depend on the order in which they arrive, so reruns agree up to rounding.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.evaluation.probability import encode_labels, require_known_labels
from quadrat.operators import scoring
from quadrat.operators.calibrate import fit_sigmoids
from quadrat.operators.runs import epoch_metrics
from quadrat.operators.staging import new_folder, stage
from quadrat.operators.train import weighted_rows

logger = logging.getLogger(__name__)

SHARDS_PER_BATCH = 4
PIECE_ROWS = 16_384  # rows of a shard that one task writes
_SLICE_ROWS = 1024
_PIECE = 1 << 16
LOG_SCHEMA = (
    "run_id string, epoch int, ref_accuracy double, val_accuracy double, val_loss double, training_loss double, "
    "cumulative_seconds double"
)

# The optimiser's decay rates and its guard against division by zero.
DECAY_1, DECAY_2, GUARD = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class EpochOptions:
    """``hidden`` holds the sizes of the hidden layers; none gives a linear head, which starts at zero.

    ``method`` is ``adam`` or ``sgd``. The penalty of a step is ``l2 / 2`` times the squared weights over the rows of its batch.
    With ``patience``, training stops after that many epochs without a smaller validation loss, and the best epoch's head is kept.
    """

    hidden: tuple[int, ...] = (500, 300, 100)
    epochs: int = 10
    batch_rows: int = 5000
    rate: float = 1e-4
    l2: float = 1e-4
    method: str = "adam"
    patience: int | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        if self.method not in ("adam", "sgd"):
            raise ValueError(f"Training knows the methods adam and sgd, not {self.method!r}.")
        if min(self.epochs, self.batch_rows, *self.hidden) < 1:
            raise ValueError("Epochs, rows of a batch and layer sizes start at 1.")
        if self.patience is not None and self.patience < 1:
            raise ValueError(f"Patience counts epochs from 1, not {self.patience}.")


@dataclass(frozen=True)
class Network:
    """Dense layers with ReLU between them and a softmax at the end."""

    weights: Sequence[np.ndarray]
    biases: Sequence[np.ndarray]

    @property
    def input_dim(self) -> int:
        return self.weights[0].shape[1]

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        """The inputs of each layer, then the natural logarithms of the probabilities."""
        out = [x]
        for i, (w, bias) in enumerate(zip(self.weights, self.biases)):
            x = x @ w.T + bias
            if i < len(self.weights) - 1:
                x = np.maximum(x, 0.0)
            out.append(x)
        z = out[-1] - out[-1].max(axis=1, keepdims=True)
        out[-1] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.exp(self.layers(x)[-1])

    def flat(self) -> np.ndarray:
        return np.concatenate([part.ravel() for pair in zip(self.weights, self.biases) for part in pair])

    def with_flat(self, values: np.ndarray) -> Network:
        weights, biases, at = [], [], 0
        for w in self.weights:
            weights.append(values[at : at + w.size].reshape(w.shape))
            biases.append(values[at + w.size : at + w.size + len(w)])
            at += w.size + len(w)
        return Network(weights, biases)

    def penalised(self) -> np.ndarray:
        """1 for the values the penalty counts (weights), 0 for the others (biases)."""
        return Network([np.ones_like(w) for w in self.weights], [np.zeros_like(b) for b in self.biases]).flat()

    def sums(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Rows, weights, weighted loss and its gradient, added up over the rows of a batch."""
        inputs = self.layers(x)
        logs, at = inputs.pop(), np.arange(len(x))
        slope = np.exp(logs)
        slope[at, label] -= 1.0
        slope *= weight[:, None]
        parts: list[np.ndarray] = []
        for i in reversed(range(len(self.weights))):
            parts[:0] = [(slope.T @ inputs[i]).ravel(), slope.sum(axis=0)]
            if i:
                slope = (slope @ self.weights[i]) * (inputs[i] > 0)
        return np.concatenate([[len(x), weight.sum(), -(weight * logs[at, label]).sum()], *parts])


@dataclass(frozen=True)
class Trained:
    """The head that is kept, the log (one row an epoch) and how training ended; epochs of the summary count from 1."""

    network: Network
    log: DataFrame
    final_epoch: int
    early_stopped: bool
    best_val_epoch: int | None
    best_val_loss: float | None


def initial(inputs: int, outputs: int, options: EpochOptions) -> Network:
    """Weights drawn uniformly within the root of 6 over inputs plus outputs of a layer; zeros for a linear head."""
    rng = np.random.default_rng(options.seed)
    sizes = [inputs, *options.hidden, outputs]
    weights = []
    for wide, out in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (wide + out)) if options.hidden else 0.0
        weights.append(rng.uniform(-bound, bound, (out, wide)) if bound else np.zeros((out, wide)))
    return Network(weights, [np.zeros(out) for out in sizes[1:]])


def deal(rows: DataFrame, key: Sequence[str], batches: int, options: EpochOptions) -> tuple[DataFrame, int]:
    """Write training rows in shards (column ``_shard``); gives the written table and the number of shards.

    A batch's rows are one shard of ``SHARDS_PER_BATCH``, so the number of folders follows the number of steps of an epoch. A shard
    is written by as many tasks as its rows need.
    """
    shards = batches * SHARDS_PER_BATCH if batches > 1 else 1
    pieces = -(-options.batch_rows // (SHARDS_PER_BATCH * PIECE_ROWS)) if batches > 1 else 1
    dealt = rows.select(
        F.col("gt_idx").cast("int").alias("gt_idx"),
        F.col("weight").cast("double").alias("weight"),
        "features",
        F.pmod(F.xxhash64(*key, F.lit(options.seed)), F.lit(shards)).cast("int").alias("_shard"),
        F.pmod(F.xxhash64(*key, F.lit(options.seed + 1)), F.lit(pieces)).cast("int").alias("_piece"),
    )
    if shards > 1:
        dealt = dealt.repartition("_shard", "_piece")
    dealt = dealt.drop("_piece")
    path = new_folder(rows.sparkSession, "training")
    dealt.write.partitionBy("_shard").parquet(path)
    return rows.sparkSession.read.schema(dealt.schema).parquet(path), shards


def gradient(rows: DataFrame, network: Network) -> np.ndarray | None:
    """Rows, weights, loss and gradient of a batch, summed over its tasks; None without rows."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = shared.value, None
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                some = batch.slice(at, _SLICE_ROWS)
                x = scoring.matrix(some.column("features"), net.input_dim)
                one = net.sums(x, some.column("gt_idx").to_numpy(), some.column("weight").to_numpy())
                total = one if total is None else total + one
        if total is not None:
            cuts = [total[at : at + _PIECE].tobytes() for at in range(0, len(total), _PIECE)]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(len(cuts)), pa.int32()), "sums": pa.array(cuts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, piece = 0.0, None
        for batch in batches:
            for piece, packed in zip(batch.column("piece").to_pylist(), batch.column("sums").to_pylist()):
                total = total + np.frombuffer(packed)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, sums binary"
    parts = rows.select("features", "gt_idx", "weight").mapInArrow(part, schema)
    added = parts.groupBy("piece").applyInArrow(add, schema).collect()  # as many values as the head has
    shared.destroy()
    if not added:
        return None
    return np.concatenate([np.frombuffer(bytes(r["sums"])) for r in sorted(added, key=lambda r: r["piece"])])


@dataclass
class Optimiser:
    """One step at a time over all parameters of a network."""

    options: EpochOptions
    steps: int = 0
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0

    def step(self, values: np.ndarray, slope: np.ndarray) -> np.ndarray:
        if self.options.method == "sgd":
            return values - self.options.rate * slope
        self.steps += 1
        self.mean = DECAY_1 * self.mean + (1 - DECAY_1) * slope
        self.square = DECAY_2 * self.square + (1 - DECAY_2) * slope**2
        scale = np.sqrt(self.square / (1 - DECAY_2**self.steps)) + GUARD
        return values - self.options.rate * self.mean / (1 - DECAY_1**self.steps) / scale


def one_epoch(table: DataFrame, shards: int, network: Network, optimiser: Optimiser, epoch: int) -> tuple[Network, float | None]:
    """All batches of an epoch, one step each; the loss is the mean over rows of the batches' losses before their step."""
    options, mask = optimiser.options, network.penalised()
    order = np.random.default_rng([options.seed, epoch]).permutation(shards)
    lost, seen = 0.0, 0.0
    for at in range(0, shards, SHARDS_PER_BATCH):
        batch = table.where(F.col("_shard").isin(order[at : at + SHARDS_PER_BATCH].tolist()))
        total = gradient(batch, network)
        # Rows whose classes all weigh nothing have no mean loss; they take no step.
        if total is None or total[1] == 0:
            continue
        n, weight, loss = total[:3]
        values = network.flat()
        loss = loss / weight + options.l2 / 2 / n * (mask * values**2).sum()
        slope = total[3:] / weight + options.l2 / n * mask * values
        network = network.with_flat(optimiser.step(values, slope))
        lost, seen = lost + loss * n, seen + n
    return network, float(lost / seen) if seen else None


def train_epochs(
    train: DataFrame,
    ref: DataFrame,
    val: DataFrame,
    classes: DataFrame,
    key: Sequence[str],
    weights: DataFrame | None = None,
    options: EpochOptions = EpochOptions(),
    run_id: str = "run",
    on_epoch: Callable[[dict], None] | None = None,
) -> Trained:
    """Train a head on ``train`` (``features``, ``gt``, key columns) and watch it on ``ref`` and ``val``.

    All labels must be in the class list, and all vectors of one length. Repeated rows count each time. A set without
    rows has NULL figures in the log; without a validation loss no epoch is the best, and the last head is kept. No training rows
    are an error.
    """
    spark = train.sparkSession
    known = stage(classes.select("class_id", "idx"), "classes")
    rows = train.count()
    first = train.select(F.size("features").alias("n")).first()
    if first is None:
        raise ValueError("There are no training rows.")
    table, shards = deal(weighted_rows(train, known, weights), key, -(-rows // options.batch_rows), options)
    sets = []
    for name, points in (("ref", ref), ("val", val)):
        require_known_labels(points, known)
        sets.append(encode_labels(points, known).select(F.lit(name).alias("split"), F.col("gt_idx").alias("gt"), "features"))
    held = stage(sets[0].unionByName(sets[1]), "held")

    network, optimiser = initial(first["n"], known.count(), options), Optimiser(options)
    kept, best_loss, best_epoch, log, start = network, None, None, [], time.monotonic()
    stopped = False
    for epoch in range(options.epochs):
        network, loss = one_epoch(table, shards, network, optimiser, epoch)
        scored = epoch_metrics(scoring.score(held, network), by=["split"]).collect()
        found = {r["split"]: r for r in scored}
        figures = {
            "run_id": run_id,
            "epoch": epoch,
            "ref_accuracy": found["ref"]["accuracy"] if "ref" in found else None,
            "val_accuracy": found["val"]["accuracy"] if "val" in found else None,
            "val_loss": found["val"]["log_loss"] if "val" in found else None,
            "training_loss": loss,
            "cumulative_seconds": time.monotonic() - start,
        }
        log.append(figures)
        val_loss = figures["val_loss"]
        if val_loss is not None and val_loss == val_loss and (best_loss is None or val_loss < best_loss):
            kept, best_loss, best_epoch = network, val_loss, epoch
        since = epoch - (-1 if best_epoch is None else best_epoch)
        stopped = options.patience is not None and since >= options.patience
        if on_epoch is not None:
            on_epoch(figures)
        if stopped:
            logger.info("No smaller validation loss for %d epochs; training ends after epoch %d.", since, epoch + 1)
            break
    watched = options.patience is not None
    return Trained(
        kept if watched and best_epoch is not None else network,
        spark.createDataFrame([tuple(row.values()) for row in log], LOG_SCHEMA),
        len(log),
        stopped,
        best_epoch + 1 if watched and best_epoch is not None else None,
        best_loss if watched else None,
    )


def calibrated(network: Network, ref: DataFrame, classes: DataFrame) -> scoring.Head:
    """The trained head with the sigmoids of its classes, fitted on reference points."""
    require_known_labels(ref, classes)
    probs = scoring.score(encode_labels(ref, classes).select("gt_idx", "features"), network)
    names = [r["class_id"] for r in classes.orderBy("idx").select("class_id").collect()]  # class-sized
    pairs = [(r["a"], r["b"]) for r in fit_sigmoids(probs, len(names)).orderBy("k").collect()]
    if len(names) == 2:
        # The first of two classes is the complement of the second: 1 - s(a p + b) = s(a (1 - p) - a - b).
        a, b = pairs[0]
        pairs = [(a, -a - b), (a, b)]
    a, b = np.array(pairs).T
    return scoring.Head(network.weights, network.biases, a, b, names)
