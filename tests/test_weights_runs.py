import math

import pytest

from quadrat.operators import runs, weights

from .conftest import rows


def brute_weight(n):
    return (1 - 0.9999) / (1 - 0.9999 ** max(n, 1))


def test_weights_and_cap(spark):
    counts = spark.createDataFrame([("a::", 1000), ("b::", 10), ("c::", 0)], "class_key string, n long")
    got = {r["class_key"]: r["weight"] for r in weights.class_weights(counts).collect()}
    assert got == pytest.approx({"a::": brute_weight(1000), "b::": brute_weight(10), "c::": 1.0}, rel=1e-9)
    capped = {r["class_key"]: r["weight"] for r in weights.class_weights(counts, weights.WeightOptions(2.0)).collect()}
    assert capped["c::"] == capped["b::"] == pytest.approx(2 * brute_weight(1000))
    single = weights.class_weights(counts.limit(1), weights.WeightOptions(1.0)).first()["weight"]
    assert single == pytest.approx(brute_weight(1000))
    assert weights.class_weights(counts, weights.WeightOptions(enabled=False)).count() == 0
    with pytest.raises(ValueError):
        weights.WeightOptions(0.5)
    one = weights.weight_summary(weights.class_weights(counts)).first()
    assert one["weight_median"] == pytest.approx(brute_weight(10)) and one["n_classes"] == 3
    assert one["weight_max_min_ratio"] == pytest.approx(1.0 / brute_weight(1000))
    none = weights.weight_summary(weights.class_weights(counts.limit(0))).first()
    assert none["weight_mean"] == 0.0 and none["n_classes"] == 0


def test_weight_table_names(spark):
    table = spark.createDataFrame(
        [("a::g", 1, 0.5), ("a::", 2, 0.7), ("odd", 3, 0.1)], "class_key string, n long, weight double"
    )
    names = spark.createDataFrame([("a", "Ay")], "id string, name string")
    forms = spark.createDataFrame([("g", "Gee")], "id string, name string")
    got = [tuple(r) for r in weights.weights_table(table, names, forms).collect()]
    assert got == [
        ("a::", "a", "Ay", "", "", 2, 0.7),
        ("a::g", "a", "Ay", "g", "Gee", 1, 0.5),
        ("odd", "", "", "", "", 3, 0.1),
    ]


def brute_stop(losses, patience):
    best, best_at, since = float("inf"), None, 0
    for epoch, loss in enumerate(losses):
        if loss < best:
            best, best_at, since = loss, epoch, 0
        else:
            since += 1
        if since >= patience:
            return epoch + 1, True, best_at, best
    return len(losses), since >= patience, best_at, best


def test_early_stopping(spark):
    runs_ = {
        "steady": [5.0, 4.0, 3.0, 2.0],
        "stops": [5.0, 4.0, 4.0, 4.5, 6.0, 1.0],
        "ties": [3.0, 3.0, 2.0, 2.0, 2.0, 2.0],
        "late": [1.0, 2.0, 0.5, 0.7, 0.6],
        "nan": [float("nan"), float("nan"), float("nan"), 1.0],
    }
    log = spark.createDataFrame(
        [(r, e, l) for r, ls in runs_.items() for e, l in enumerate(ls)], "run_id string, epoch long, val_loss double"
    )
    got = {r["run_id"]: r for r in runs.early_stopping(log, 3).collect()}
    for name, losses in runs_.items():
        final, early, best_at, best = brute_stop(losses, 3)
        r = got[name]
        assert (r["final_epoch"], r["early_stopped"]) == (final, early), name
        assert r["best_val_epoch"] == (None if best_at is None else best_at + 1)
        assert r["best_val_loss"] == (None if math.isinf(best) else best)


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, s string")
    base = runs.fingerprint(df).first()
    assert runs.fingerprint(df.repartition(3).orderBy("s")).first() == base
    assert runs.fingerprint(df.where("k < 3")).first() != base
    assert runs.fingerprint(df.union(df.limit(1))).first() != base
    assert runs.fingerprint(df.limit(0)).first()["rows"] == 0


def test_shards_and_headline(spark):
    items = spark.createDataFrame([(i,) for i in range(5)], "item int")
    assert rows(runs.shards(items, 2, ["item"])) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]
    assert runs.shards(items, 9, ["item"]).select("shard").distinct().count() == 5
    with pytest.raises(ValueError):
        runs.shards(items, 0, ["item"])
    scalars = spark.createDataFrame([("mcc", 0.5), ("accuracy", 0.9), ("other", 1.0)], "name string, value double")
    assert [r["name"] for r in runs.headline(scalars).collect()] == ["accuracy", "mcc"]
