import pytest
from pyspark.sql import functions as F

from quadrat.operators import features
from quadrat.sources import tables

from .conftest import rows


@pytest.fixture(scope="module")
def five(spark):
    df = spark.createDataFrame(
        [("b", f"f{i}", j) for i in range(5) for j in range(2)], "bucket string, feature_vector string, n int"
    )
    return features.with_full_path(df)


def listing(spark, n):
    return spark.createDataFrame([(f"b/f{i}",) for i in range(n)] + [("b/other",)], "feature_full string")


@pytest.mark.parametrize("percent, passes", [(39, False), (40, True), (50, True)])
def test_gate(spark, five, percent, passes):
    if passes:
        assert features.require_features(five, listing(spark, 3), percent).count() == 6
    else:
        with pytest.raises(features.MissingFeatures, match=r"2 of 5 .*b/f3.*b/f4"):
            features.require_features(five, listing(spark, 3), percent)


def test_no_tolerance_and_nothing_missing(spark, five):
    with pytest.raises(features.MissingFeatures):
        features.require_features(five, listing(spark, 4))
    assert features.require_features(five, listing(spark, 5)).count() == 10


def test_points_by_image_at_any_size(spark):
    df = spark.createDataFrame(
        [("b", "x", i, i % 3, "A", "") for i in range(25)] + [("b", "y", 1, 1, "A", ""), ("b", "y", 1, 1, "B", "f")],
        "bucket string, feature_vector string, row int, col int, attribute_id string, form_id string",
    )
    assert rows(features.image_counts(df)) == [("b", "x", 25), ("b", "y", 2)]
    listed = [tuple(r) for r in features.image_points(df).collect()]
    assert listed == sorted(listed) and len(listed) == 27
    assert listed[-2:] == [("b", "y", 1, 1, "A::"), ("b", "y", 1, 1, "B::f")]


def test_work_list_skips_finished(spark):
    rows_ = spark.createDataFrame(
        [("1", "a", 5, 5), ("1", "a", 1, 2), ("1", "a", 1, 2), ("1", "b", 1, 1), ("2", "a", 3, 3)],
        "source_id string, image_id string, row int, col int",
    )
    done = tables.existing_images(
        spark.createDataFrame(
            [("bucket/s1/features/ib.featurevector",), ("bucket/s9/readme.txt",)], "feature_full string"
        )
    )
    work = features.extraction_work(rows_, done, "in/").orderBy("source_id").collect()
    assert [(r["source_id"], r["image_id"]) for r in work] == [("1", "a"), ("2", "a")]
    assert [r["points"] for r in work] == [2, 1]
    assert rows(features.extraction_points(rows_, done)) == [("1", "a", 1, 2), ("1", "a", 5, 5), ("2", "a", 3, 3)]
    assert work[0]["image_path"] == "in/s1/images/a.jpg"
    assert work[0]["feature_path"] == "s1/features/ia.featurevector"
    assert features.extraction_work(rows_, done, force=True).count() == 3


def test_drift(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 2.0])], "id int, features array<double>")
    same = features.drift_summary(features.drift_rows(a, a, ["id"])).first()
    assert same["passed"] and same["n"] == 3 and same["max_abs_diff"] == 0.0
    b = a.withColumn("features", F.when(F.col("id") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.col("features")))
    with pytest.raises(RuntimeError, match="cosine"):
        features.require_no_drift(features.drift_rows(a, b, ["id"]))


def test_flatten_and_ragged(spark):
    df = spark.createDataFrame(
        [("i", [(1, 2, [1.0, 2.0]), (3, 4, [5.0, 6.0])])],
        "image_id string, point_features array<struct<row:int,col:int,data:array<double>>>",
    )
    flat = tables.flatten_features(df)
    assert rows(flat, "image_id", "row", "col") == [("i", 1, 2), ("i", 3, 4)]
    assert tables.check_one_dimension(flat) == 2
    ragged = flat.union(spark.createDataFrame([("j", 1, 1, [1.0])], flat.schema))
    with pytest.raises(ValueError, match="1 to 2"):
        tables.check_one_dimension(ragged)


def test_listing_is_neither_sorted_nor_needs_to_be_distinct(spark, five, monkeypatch):
    plans = []

    def kept(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.cache()

    monkeypatch.setattr(features, "stage", kept)
    twice = listing(spark, 5).union(listing(spark, 5))
    assert features.require_features(five, twice).count() == 10
    assert all("SortMergeJoin" not in p and "Sort " not in p for p in plans)
