"""Ordered folds over groups that are smaller and larger than a task."""

import itertools
import random

import pytest

from quadrat.operators.features import point_walks
from quadrat.operators.folding import fold_groups


def joined(batch):
    return (batch.num_rows, "".join(batch.column("letter").to_pylist()))


def plus(a, b):
    return a[0] + b[0], a[1] + b[1]


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (9, 7)])
def test_runs_are_joined_in_order_over_batches_and_tasks(spark, parts, batch):
    rng = random.Random(3)
    data = [("large", None, k) for k in range(400)] + [(None, 1, k) for k in range(60)] + [(f"g{k % 50:02}", k % 3, k) for k in range(300)]
    data = [(g, h, k, rng.choice("abc")) for g, h, k in data]
    df = spark.createDataFrame(data, "g string, h int, k int, letter string").repartition(4)
    settings = {"spark.sql.shuffle.partitions": parts, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = fold_groups(df, ["g", "h"], ["k"], joined, plus, "n long, text string").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    want = {}
    for g, h, _, letter in sorted(data, key=lambda r: (str(r[0]), str(r[1]), r[2])):
        n, text = want.get((g, h), (0, ""))
        want[g, h] = n + 1, text + letter
    assert {(r.g, r.h): (r.n, r.text) for r in got} == want and len(got) == len(want)
    assert fold_groups(df.limit(0), ["g"], ["k"], joined, plus, "n long, text string").count() == 0


def test_point_walks(spark):
    points = [("b", f, r, c) for f, r, c in itertools.product(["x", "y"], range(5), (3, 1))] + [("b", "x", None, 1), ("b", None, 2, 2)]
    df = spark.createDataFrame(points, "bucket string, feature_vector string, row int, col int")
    got = {r.feature_vector: tuple(r)[2:] for r in point_walks(df).collect()}
    assert got == {"x": (10, 0, 1, 4, 3, 22), "y": (10, 0, 1, 4, 3, 22), None: (1, 2, 2, 2, 2, 0)}
