import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quadrat.operators import calibrate, scoring, train

from .conftest import rows


def brute_head(head, x):
    out = []
    for row in x:
        for i, (w, b) in enumerate(zip(head.weights, head.biases)):
            row = [sum(w[k][j] * row[j] for j in range(len(row))) + b[k] for k in range(len(b))]
            if i < len(head.weights) - 1:
                row = [max(v, 0) for v in row]
        p = np.exp(row) / np.exp(row).sum()
        c = 1 / (1 + np.exp(head.a * p + head.b))
        out.append(c / c.sum())
    return np.array(out)


def small_head():
    rng = np.random.default_rng(1)
    return scoring.Head(
        [rng.normal(size=(5, 4)), rng.normal(size=(3, 5))], [rng.normal(size=5), rng.normal(size=3)],
        np.array([-3.0, -2.0, -4.0]), np.array([0.5, 0.2, 1.0]), ["a::", "b::", "c::"],
    )


def test_scoring(spark):
    head = small_head()
    x = np.random.default_rng(3).normal(size=(23, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, features array<double>")
    scoring.require_dimension(df, head)
    got = scoring.score(df.repartition(3), head).orderBy("i").collect()
    assert np.allclose([r["proba"] for r in got], brute_head(head, x))
    short = spark.createDataFrame([(1, [1.0, 2.0])], "i int, features array<double>")
    with pytest.raises(ValueError, match="must have 4 values; got 2"):
        scoring.require_dimension(short, head)
    with pytest.raises(PythonException, match="must have 4 values"):
        scoring.score(short, head).collect()


def test_head_checks():
    one = [np.ones((2, 3))]
    with pytest.raises(ValueError, match="no layer"):
        scoring.Head([], [], np.ones(2), np.ones(2), ["a", "b"])
    with pytest.raises(ValueError, match="1 weights and 0 biases"):
        scoring.Head(one, [], np.ones(2), np.ones(2), ["a", "b"])
    with pytest.raises(ValueError, match="sigmoid parameters of shapes"):
        scoring.Head(one, [np.ones(2)], np.ones(2), np.ones(3), ["a", "b"])
    with pytest.raises(ValueError, match="2 outputs for 3 classes"):
        scoring.Head(one, [np.ones(2)], np.ones(3), np.ones(3), ["a", "b", "c"])
    # No class gets any weight: the row becomes uniform. An overshoot within rounding is set to 1.
    far = scoring.Head(one, [np.zeros(2)], np.full(2, 1e4), np.full(2, 1e4), ["a", "b"])
    with np.errstate(over="ignore"):
        assert far.predict(np.ones((1, 3))).tolist() == [[0.5, 0.5]]


def test_probability_tables(spark):
    df = spark.createDataFrame([(1, [0.2, 0.5, 0.3]), (2, [0.4, 0.4, 0.2])], "i int, proba array<double>")
    classes = spark.createDataFrame([(0, "a::"), (1, "b::"), (2, "c::")], "idx int, class_id string")
    assert rows(scoring.top_label(df, classes), "i", "est", "score") == [(1, "b::", 0.5), (2, "a::", 0.4)]
    assert rows(scoring.top_labels(df, classes, 2)) == [
        (1, 1, "b::", 0.5), (1, 2, "c::", 0.3), (2, 1, "a::", 0.4), (2, 2, "b::", 0.4),
    ]
    assert not scoring.row_sum_drift(df).first()["suspicious"]
    off = df.withColumn("proba", F.transform("proba", lambda p: p * 1.01))
    assert scoring.warn_on_drift(off) == pytest.approx(0.01)
    assert scoring.require_parity(df, scoring.renormalised(off), ["i"]).first()["n"] == 2
    with pytest.raises(ValueError, match="differ by up to"):
        scoring.require_parity(df, off, ["i"])
    zero = spark.createDataFrame([([0.0, 0.0],)], "proba array<double>")
    assert scoring.renormalised(zero).first()[0] == [0.5, 0.5]


def objective(params, f, t):
    z = params[0] * f + params[1]
    return (t * np.logaddexp(0, z) + (1 - t) * np.logaddexp(0, -z)).sum()


@pytest.mark.parametrize("k", [2, 4])
def test_sigmoid_fit_is_the_optimum(spark, k):
    rng = np.random.default_rng(k)
    proba = rng.dirichlet(np.ones(k) * 0.7, size=150)
    gt = np.array([rng.choice(k, p=0.6 * p + 0.4 / k) for p in proba])
    df = spark.createDataFrame(
        [(int(g), [float(v) for v in p]) for g, p in zip(gt, proba)], "gt_idx int, proba array<double>"
    )
    fitted = {r["k"]: r for r in calibrate.fit_sigmoids(df, k).collect()}
    assert sorted(fitted) == ([1] if k == 2 else list(range(k)))
    for c, r in fitted.items():
        f, y = proba[:, c], gt == c
        t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
        best = objective((r["a"], r["b"]), f, t)
        for da, db in [(1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)]:
            assert objective((r["a"] + da, r["b"] + db), f, t) > best - 1e-9
        z = r["a"] * f + r["b"]
        gradient = t - 1 / (1 + np.exp(z))
        assert abs((gradient * f).sum()) < 1e-4 and abs(gradient.sum()) < 1e-4
        assert r["converged"]
    lifted = calibrate.apply_sigmoids(df, calibrate.fit_sigmoids(df, k)).collect()
    assert all(sum(r["proba"]) == pytest.approx(1) and min(r["proba"]) > 0 for r in lifted)
    if k == 2:
        r = fitted[1]
        want = 1 / (1 + np.exp(r["a"] * proba[:, 1] + r["b"]))
        assert sorted(x["proba"][1] for x in lifted) == pytest.approx(sorted(want))
    with pytest.raises(calibrate.NotConverged):
        calibrate.fit_sigmoids(df, k, steps=2)


def test_training_separates_clusters(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(scale=4, size=(3, 8))
    data = [(f"c{i % 3}::", [float(v) for v in centers[i % 3] + rng.normal(size=8)]) for i in range(150)]
    points = spark.createDataFrame(data, "gt string, features array<double>")
    classes = spark.createDataFrame([(i, f"c{i}::") for i in range(3)], "idx int, class_id string")
    w = spark.createDataFrame([(f"c{i}::", 1.0 + i) for i in range(3)], "class_id string, weight double")
    model = train.train_head(points, classes, w, max_iter=15)
    scored = scoring.top_label(train.predict(model, points), classes)
    assert scored.where("gt = est").count() > 140
    with pytest.raises(ValueError, match="c2::"):
        train.train_head(points, classes, w.limit(2))
    strange = points.union(spark.createDataFrame([("zzz::", [0.0] * 8)], points.schema))
    with pytest.raises(ValueError, match="zzz"):
        train.training_rows(strange, classes, w)


def test_training_is_the_optimum(spark):
    """The weighted loss with its penalty does not fall in any direction tried from the fitted weights."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + rng.normal(size=120) > 0).astype(int) + (x[:, 1] > 0.8)
    points = spark.createDataFrame([(f"c{k}::", [float(v) for v in r]) for k, r in zip(y, x)], "gt string, features array<double>")
    classes = spark.createDataFrame([(i, f"c{i}::") for i in range(3)], "idx int, class_id string")
    w = spark.createDataFrame([(f"c{i}::", 1.0 + i) for i in range(3)], "class_id string, weight double")
    model = train.train_head(points, classes, w, l2=0.01)
    weights = 1.0 + y

    def loss(coefficients, intercepts):
        z = x @ coefficients.T + intercepts
        z = z - z.max(axis=1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        spread = (x * np.sqrt(weights[:, None])).std(axis=0)
        return -(weights * logp[np.arange(120), y]).sum() / weights.sum(), spread

    c, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    mean = np.average(x, axis=0, weights=weights)
    scale = np.sqrt((weights[:, None] * (x - mean) ** 2).sum(axis=0) / (weights.sum() - (weights**2).sum() / weights.sum()))

    def penalised(c, b):
        return loss(c, b)[0] + 0.01 / 2 * ((c * scale) ** 2).sum()

    best = penalised(c, b)
    for _ in range(40):
        dc, db = rng.normal(size=c.shape) * 0.02, rng.normal(size=b.shape) * 0.02
        assert penalised(c + dc, b + db) > best - 1e-5
