import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quadrat.functions import keys
from quadrat.operators import prepare
from quadrat.sources import tables

from .conftest import rows


@pytest.fixture(scope="module")
def mapping(spark):
    return spark.createDataFrame(
        [("5", "L5", "a1", "A one", None, None), ("6", "L6", "a2", "A two", "g1", "G one")],
        "provider_id string, provider_label string, attribute_id string, attribute_name string, form_id string, form_name string",
    )


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(
        [("p1", "i1", "5"), ("p1", "i1", "6"), ("p1", "i2", "9"), ("p2", "i3", "9"), ("p2", "i3", None)],
        "project_id string, image_id string, label_id string",
    )


def test_mapping_unmapped_and_missing_form(points, mapping):
    mapped = prepare.map_labels(points, mapping)
    assert mapped.count() == 4  # the row without a label is gone
    assert rows(prepare.drop_unmapped(mapped), "label_id", "attribute_id", "form_id") == [
        ("5", "a1", ""),
        ("6", "a2", "g1"),
    ]
    assert rows(prepare.unmapped_labels(mapped)) == [("9", 2, 2)]


def test_native_forms_and_append(spark):
    native = tables.to_native_points(
        spark.createDataFrame(
            [("i", 1, 2, "a", "None"), ("i", 1, 3, "a", "g"), ("i", 1, 4, "a", None)],
            "image_id string, row int, col int, attribute_id string, form_id string",
        )
    )
    assert rows(prepare.normal_forms(native), "col", "form_id", "project_id", "feature_vector") == [
        (2, "", "all", "native/i_featurevector"),
        (3, "g", "all", "native/i_featurevector"),
    ]
    other = spark.createDataFrame([("i9", "L", "a", "")], "image_id string, label_id string, attribute_id string, form_id string")
    both = prepare.append_native(other, native)
    assert both.count() == 4 and both.where("label_id IS NULL").count() == 3
    assert prepare.append_native(None, native) is native


def test_rollup_is_single_pass(spark):
    df = spark.createDataFrame([("a", "", 1), ("b", "", 2), ("c", "g", 3)], "attribute_id string, form_id string, n int")
    spec = spark.createDataFrame(
        [("a", "", "b", ""), ("b", "", "c", "g")],
        "from_attribute_id string, from_form_id string, to_attribute_id string, to_form_id string",
    )
    assert rows(prepare.roll_up(df, spec)) == [("b", "", 1), ("c", "g", 2), ("c", "g", 3)]
    assert prepare.roll_up(df, spec).columns == df.columns


def test_filters(spark):
    df = spark.createDataFrame([("a", ""), ("a", "g"), ("b", "")], "attribute_id string, form_id string")
    spec = spark.createDataFrame([("a", ""), ("z", "")], "attribute_id string, form_id string")
    assert rows(prepare.filter_classes(df, include=spec)) == [("a", "")]
    assert rows(prepare.filter_classes(df, exclude=spec)) == [("a", "g"), ("b", "")]
    assert prepare.filter_classes(df) is df
    with pytest.raises(ValueError):
        prepare.filter_classes(df, spec, spec)


def test_map_distinct_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, n int")
    assert rows(prepare.map_distinct(df, "k", F.upper)) == [("A", 1), ("A", 2), ("B", 4)]
    by_function = prepare.map_distinct(df, "k", lambda s: s * 2, "k2", "string")
    assert rows(by_function) == [("a", 1, "aa"), ("a", 2, "aa"), ("b", 4, "bb")]
    assert rows(prepare.map_distinct(df, "k", lambda s: s * 2, returns="string")) == [("aa", 1), ("aa", 2), ("bb", 4)]
    assert rows(prepare.keep_where(df, "k", lambda s: s == "a", python=True)) == [("a", 1), ("a", 2)]
    assert rows(prepare.keep_where(df, "k", lambda c: c == "b")) == [("b", 4)]


def test_class_keys(spark):
    df = spark.createDataFrame([("a::",), ("a::g",)], "k string")
    part = keys.class_parts("k")
    assert rows(df.select(part["attribute"], part["form"])) == [("a", ""), ("a", "g")]
    for bad in ("a", "a::b::c", "::g"):
        with pytest.raises(PySparkException, match="class key"):
            spark.createDataFrame([(bad,)], "k string").select(keys.class_parts("k")["form"]).collect()


def test_retention_percent(spark):
    before = spark.createDataFrame([("f1",), ("f1",), ("f2",), ("f3",)], "feature_vector string")
    kept = before.where("feature_vector <> 'f1'")
    one = prepare.retention(before, before, kept).first()
    assert (one["annotations_kept_pct"], one["annotations_lost_filter"], one["images_lost_filter"]) == (50.0, 2, 1)


def test_lookup_tables_multiply_nothing(spark):
    df = spark.createDataFrame([("1", "x"), (None, "y")], "label_id string, v string")
    mapping = spark.createDataFrame([("1", "a", ""), ("1", "a", ""), ("2", "b", "")], "provider_id string, attribute_id string, form_id string")
    assert prepare.map_labels(df, mapping).count() == 1
    assert prepare.look_up_labels(df, mapping).count() == 2
    with pytest.raises(ValueError, match="'1'"):
        prepare.map_labels(df, mapping.union(spark.createDataFrame([("1", "c", "")], mapping.schema)))
    points = spark.createDataFrame([("a", "")], "attribute_id string, form_id string")
    rule = [("a", "", "b", "")]
    schema = "from_attribute_id string, from_form_id string, to_attribute_id string, to_form_id string"
    assert rows(prepare.roll_up(points, spark.createDataFrame(rule * 2, schema))) == [("b", "")]
    with pytest.raises(ValueError, match="rollup"):
        prepare.roll_up(points, spark.createDataFrame([*rule, ("a", "", "c", "")], schema))


def test_images_are_counted_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(prepare, "ROWS_AT_ONCE", 10)
    marked = spark.range(200).selectExpr("if(id < 3, null, concat('f', id % 90)) feature_vector", "id % 90 < 40 _kept")
    images = prepare.per_image(marked, F.count(F.lit(1)).alias("all"))
    assert images.rdd.getNumPartitions() == 20
    one = prepare.retention_of_marked(marked).first()
    kept = marked.where("_kept")
    assert (one["annotations_before"], one["images_before"]) == (200, 90)
    assert (one["annotations_filter"], one["images_filter"]) == (kept.count(), 40)
    assert prepare.stage_counts(marked, "x").first() == ("x", 200, 90)
    assert prepare.stage_counts(marked.limit(0), "x").first() == ("x", 0, 0)
