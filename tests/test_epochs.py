import logging

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quadrat.operators import epochs, runs, scoring, train

NAMES = ["a::", "b::", "c::"]


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def points(spark, n, seed, parts=3):
    """Three clouds in four dimensions, rows and arrays."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = np.round(rng.normal(size=(n, 4)) + 1.5 * np.eye(3, 4)[y], 3)
    rows = [(seed * 100_000 + i, NAMES[y[i]], [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, gt string, features array<double>").repartition(parts), x, y


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(c, i) for i, c in enumerate(NAMES)], "class_id string, idx int")


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame(list(zip(NAMES, [1.0, 2.0, 0.5])), "class_id string, weight double")


def test_full_batch_step_equals_numpy(spark, classes, weights):
    rows, x, y = points(spark, 60, 1)
    ref, _, _ = points(spark, 20, 2)
    val, vx, vy = points(spark, 20, 3)
    options = epochs.EpochOptions(hidden=(), epochs=1, batch_rows=1000, rate=0.7, l2=0.1, method="sgd")
    got = epochs.train_epochs(rows, ref, val, classes, ["id"], weights, options)

    w = np.array([1.0, 2.0, 0.5])[y]
    slope = (np.full((60, 3), 1 / 3) - np.eye(3)[y]) * w[:, None] / w.sum()
    layer, bias = -0.7 * slope.T @ x, -0.7 * slope.sum(axis=0)
    assert np.allclose(got.network.weights[0], layer, atol=1e-12)
    assert np.allclose(got.network.biases[0], bias, atol=1e-12)
    log = got.log.collect()
    p = softmax(vx @ layer.T + bias)
    assert [r["epoch"] for r in log] == [0]
    assert log[0]["training_loss"] == pytest.approx(np.log(3))
    assert log[0]["val_loss"] == pytest.approx(-np.log(p[np.arange(20), vy]).mean())
    assert log[0]["val_accuracy"] == pytest.approx((p.argmax(axis=1) == vy).mean())
    assert (got.final_epoch, got.early_stopped, got.best_val_epoch, got.best_val_loss) == (1, False, None, None)


def test_gradient_of_hidden_layers_is_the_slope_of_the_loss():
    rng = np.random.default_rng(5)
    net = epochs.initial(4, 3, epochs.EpochOptions(hidden=(6, 5), seed=2))
    net = net.with_flat(net.flat() + 0.05 * rng.normal(size=net.flat().size))
    x, y, w = rng.normal(size=(30, 4)), rng.integers(0, 3, 30), rng.uniform(0.5, 2, 30)
    total = net.sums(x, y, w)
    for at in rng.choice(net.flat().size, 40, replace=False):
        nudge = np.zeros(net.flat().size)
        nudge[at] = 1e-6
        up, down = (net.with_flat(net.flat() + s * nudge).sums(x, y, w)[2] for s in (1, -1))
        assert total[3 + at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_mini_batches_replayed(spark, classes, weights):
    """Batches are read back from the written shards and replayed in numpy, with its own Adam."""
    rows, x, y = points(spark, 90, 4)
    options = epochs.EpochOptions(hidden=(5,), epochs=2, batch_rows=30, rate=0.01, l2=0.02, seed=3)
    table, shards = epochs.deal(train.weighted_rows(rows, classes, weights), ["id"], 3, options)
    assert shards == 12 and table.count() == 90
    scan = table.where(F.col("_shard").isin([0, 5]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_shard" in scan.replace("[isnotnull(_shard", "[_shard")
    net, best = epochs.initial(4, 3, options), epochs.Optimiser(options)
    for epoch in range(2):
        net, loss = epochs.one_epoch(table, shards, net, best, epoch)

    held = {s: ([], [], []) for s in range(shards)}
    for r in table.collect():
        for store, v in zip(held[r["_shard"]], (r["features"], r["gt_idx"], r["weight"])):
            store.append(v)
    start = epochs.initial(4, 3, options)
    w1, w2 = (np.array(w) for w in start.weights)
    b1, b2 = (np.array(b) for b in start.biases)
    mean = [np.zeros_like(v) for v in (w1, b1, w2, b2)]
    square, t = [np.zeros_like(v) for v in mean], 0
    for epoch in range(2):
        order, lost = np.random.default_rng([3, epoch]).permutation(12), 0.0
        for at in range(0, 12, 4):
            x, y, w = (np.array([v for s in order[at : at + 4] for v in held[s][i]]) for i in range(3))
            h = np.maximum(x @ w1.T + b1, 0)
            p = softmax(h @ w2.T + b2)
            lost += len(x) * ((w * -np.log(p[np.arange(len(x)), y])).sum() / w.sum() + 0.01 / len(x) * ((w1**2).sum() + (w2**2).sum()))
            d2 = (p - np.eye(3)[y]) * w[:, None] / w.sum()
            d1 = d2 @ w2 * (h > 0)
            slopes = [d1.T @ x + 0.02 / len(x) * w1, d1.sum(0), d2.T @ h + 0.02 / len(x) * w2, d2.sum(0)]
            t += 1
            values = []
            for i, (v, g) in enumerate(zip((w1, b1, w2, b2), slopes)):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                values.append(v - 0.01 * (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8))
            w1, b1, w2, b2 = values
    for got, want in zip((*net.weights, *net.biases), (w1, w2, b1, b2)):
        assert np.allclose(got, want, atol=1e-9)
    assert loss == pytest.approx(lost / 90)


def test_stops_by_patience_and_keeps_the_best(spark, classes):
    rows, _, _ = points(spark, 30, 6)
    ref, _, _ = points(spark, 15, 7)
    val, vx, vy = points(spark, 15, 8)
    seen = []
    # A rate far too large: the validation loss moves up and down.
    options = epochs.EpochOptions(hidden=(4,), epochs=12, batch_rows=100, rate=0.4, patience=2, seed=1)
    got = epochs.train_epochs(rows, ref, val, classes, ["id"], None, options, "r1", seen.append)
    log = got.log.orderBy("epoch").collect()
    assert [r["epoch"] for r in seen] == [r["epoch"] for r in log] == list(range(got.final_epoch))
    # The summary is that of the windowed query over the log.
    told = runs.early_stopping(got.log, 2).first()
    assert told["final_epoch"] == got.final_epoch and told["early_stopped"] == got.early_stopped
    assert told["best_val_epoch"] == got.best_val_epoch and told["best_val_loss"] == got.best_val_loss
    assert got.early_stopped and got.final_epoch < 12
    own = -np.log(got.network.predict(vx)[np.arange(15), vy]).mean()
    assert own == pytest.approx(got.best_val_loss)


def test_learns_and_is_calibrated(spark, classes):
    rows, _, _ = points(spark, 400, 9)
    ref, rx, ry = points(spark, 200, 10)
    options = epochs.EpochOptions(hidden=(8,), epochs=6, batch_rows=100, rate=0.03)
    got = epochs.train_epochs(rows, ref, ref, classes, ["id"], None, options)
    losses = [r["training_loss"] for r in got.log.orderBy("epoch").collect()]
    assert losses[-1] < 0.7 * losses[0]
    head = epochs.calibrated(got.network, ref, classes)
    p = head.predict(rx)
    assert (p.argmax(axis=1) == ry).mean() > 0.7 and np.allclose(p.sum(axis=1), 1)
    assert head.classes == NAMES
    shown = np.array([r["proba"] for r in scoring.score(ref.select("id", "features"), head).orderBy("id").collect()])
    assert np.allclose(shown, p)


def test_two_classes(spark):
    two = spark.createDataFrame([("a::", 0), ("b::", 1)], "class_id string, idx int")
    rows, x, _ = points(spark, 120, 11)
    rows = rows.where("gt <> 'c::'")
    got = epochs.train_epochs(rows, rows, rows, two, ["id"], None, epochs.EpochOptions(hidden=(), epochs=3, rate=0.1))
    p = epochs.calibrated(got.network, rows, two).predict(x)
    assert np.allclose(p.sum(axis=1), 1)


def test_odd_inputs(spark, classes, weights):
    rows, _, _ = points(spark, 20, 12)
    none = rows.limit(0)
    options = epochs.EpochOptions(hidden=(), epochs=2, method="sgd", patience=5)
    with pytest.raises(ValueError, match="no training rows"):
        epochs.train_epochs(none, rows, rows, classes, ["id"], None, options)
    got = epochs.train_epochs(rows, none, none, classes, ["id"], None, options)
    assert [(r["ref_accuracy"], r["val_loss"]) for r in got.log.collect()] == [(None, None)] * 2
    assert got.best_val_epoch is None and not got.early_stopped
    with pytest.raises(ValueError, match="not in the class list"):
        epochs.train_epochs(rows, rows, rows.withColumn("gt", F.lit("z::")), classes, ["id"], None, options)
    short = rows.withColumn("features", F.expr("CASE WHEN id % 3 = 0 THEN slice(features, 1, 2) ELSE features END"))
    with pytest.raises(PythonException, match="values; got"):
        epochs.train_epochs(short, rows, rows, classes, ["id"], None, options)
    # Batches whose rows all weigh nothing take no step.
    idle = weights.withColumn("weight", F.lit(0.0))
    still = epochs.train_epochs(rows, rows, rows, classes, ["id"], idle, options)
    assert not still.network.flat().any() and still.log.first()["training_loss"] is None
    # Every row with one key: one shard holds them all.
    same = rows.withColumn("id", F.lit(1))
    assert epochs.train_epochs(same, rows, rows, classes, ["id"], None, epochs.EpochOptions(hidden=(), epochs=1, batch_rows=5)).final_epoch == 1
    for wrong in ({"method": "x"}, {"epochs": 0}, {"patience": 0}, {"hidden": (0,)}):
        with pytest.raises(ValueError):
            epochs.EpochOptions(**wrong)


def test_unsettled_head_is_reported(spark, classes, caplog):
    rows, _, _ = points(spark, 40, 13)
    with caplog.at_level(logging.WARNING, logger="quadrat.operators.train"):
        train.train_head(rows, classes, max_iter=1)
    assert "not settled after 1 steps" in caplog.text
