"""Feature vectors stored by point key, and the scope of staged tables."""

import os

import pytest

from quadrat.operators import features, split
from quadrat.operators.prepare import require_one_row
from quadrat.operators.staging import stage, staging_root, staging_scope
from tests.conftest import rows

KEY = "bucket string, feature_vector string, row int, col int"


def vectors(spark, n=400, images=7):
    data = [("b", None if k == 5 else f"f{k % images}", k, k % 3, [float(k), 1.0]) for k in range(n)]
    return spark.createDataFrame(data, f"{KEY}, features array<double>")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(plan, leaf):
    """Operators over the scan whose line holds ``leaf``: those of smaller depth before it."""
    lines = [line for line in plan.split("\n") if line.strip()]
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    at = next(k for k, line in enumerate(lines) if leaf in line)
    out, least = [], depth[at]
    for k in range(at - 1, -1, -1):
        if depth[k] < least:
            out.append(lines[k])
            least = depth[k]
    return out


def test_no_vector_moves(spark):
    stored = features.store_features(vectors(spark))
    points = spark.createDataFrame([("b", f"f{k % 7}", k, k % 3, f"label{k}") for k in range(0, 500, 2)], f"{KEY}, label string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = features.join_features(points, stored)
        plan = plan_of(joined)
        assert plan.count("Exchange") == 1
        assert not any("Exchange" in line for line in above(plan, "FileScan parquet"))
        got = rows(joined, "row", "label", "features")
        assert "Exchange" not in plan_of(stored.groupBy(*features.PHYSICAL_KEY).count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(k, f"label{k}", [float(k), 1.0]) for k in range(0, 400, 2)]


def test_two_vectors_of_a_point_are_refused(spark):
    twice = vectors(spark).unionByName(vectors(spark).where("row = 3"))
    with pytest.raises(ValueError, match="More than one feature vector"):
        features.store_features(twice)
    with pytest.raises(ValueError, match="More than one feature vector"):
        features.require_one_vector(twice)
    assert features.store_features(vectors(spark).limit(0)).count() == 0


def test_tags_keep_every_row_once(spark):
    points = spark.createDataFrame([("b", "f", 1, 1), ("b", "f", 1, 1), ("b", "g", 2, 2)], KEY)
    given = [("b", "f", 1, 1, "val"), ("b", "f", 1, 1, "val"), ("b", "h", 9, 9, None)]
    tagged = split.tag_splits(points, spark.createDataFrame(given, f"{KEY}, training_set string"))
    assert sorted(map(str, tagged.collect())) == sorted(
        map(str, spark.createDataFrame([("b", "f", 1, 1, "val")] * 2 + [("b", "g", 2, 2, None)], f"{KEY}, training_set string").collect())
    )
    other = spark.createDataFrame([*given, ("b", "f", 1, 1, "ref")], f"{KEY}, training_set string")
    with pytest.raises(ValueError, match="split assignment"):
        split.tag_splits(points, other)
    require_one_row(spark.createDataFrame(given, f"{KEY}, training_set string"), features.PHYSICAL_KEY, "x")


def test_scope_removes_what_was_staged_inside(spark):
    root = staging_root(spark)
    outside = stage(spark.range(3), "outside")
    with staging_scope(spark) as outer:
        kept = stage(spark.range(4), "outer")
        with staging_scope(spark) as inner:
            stored = features.store_features(vectors(spark))
            table, folders = inner.tables[0], [*inner.folders]
            assert stored.count() == 400 and spark.catalog.tableExists(table) and all(map(os.path.isdir, folders))
        assert not spark.catalog.tableExists(table) and not any(map(os.path.exists, folders))
        assert kept.count() == 4
        last = outer.folders[0]
    assert not os.path.exists(last) and outside.count() == 3
    with pytest.raises(RuntimeError, match="stop"):
        with staging_scope(spark) as failed:
            stage(spark.range(5), "failed")
            raise RuntimeError("stop")
    assert failed.folders and not any(map(os.path.exists, failed.folders))
    assert root == staging_root(spark)
