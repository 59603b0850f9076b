import pytest

from quadrat.operators import manifest
from quadrat.sources import sinks, tables

from .conftest import rows

ANN = "source_id int, image_id string, row int, col int, label_id int, status string"


@pytest.fixture(scope="module")
def raw(spark):
    ann = spark.createDataFrame(
        [(1, "a", 10, 20, 5, None), (1, "b", 1, 2, 6, "x"), (2, "c", 3, 4, 7, None), (2, "d", 3, 4, 7, None)], ANN
    )
    img = spark.createDataFrame(
        [
            (1, "a", "k/a", 100, 50, 100, 9, False, "ok", None),
            (1, "b", "k/b", 100, 50, 100, 9, False, "header_read_failed", "bad"),
            (2, "c", "k/c", 200, 80, 200, 9, False, "ok", None),
            (2, "d", None, 200, 80, 200, 9, False, "ok", None),
        ],
        tables.RAW_IMAGES,
    )
    return ann, img


def test_only_valid_images_in_column_order(raw):
    built = manifest.build_manifest(*raw)
    assert tuple(built.columns) == manifest.MANIFEST_COLUMNS
    assert rows(built, "source_id", "image_id", "image_s3_key", "load_width") == [
        (1, "a", "k/a", 100),
        (2, "c", "k/c", 200),
    ]
    one = built.first()
    assert one["source_label_name"] is None and one["uses_resized_image"] is False
    assert dict(built.dtypes)["source_label_name"] == "string"


def test_source_subset(raw, spark):
    assert rows(manifest.build_manifest(*raw, ["2"]), "image_id") == [("c",)]
    assert len(rows(manifest.build_manifest(*raw, []))) == 2
    ids = spark.createDataFrame([(1,)], "source_id int")
    assert rows(manifest.build_manifest(*raw, ids), "image_id") == [("a",)]
    with pytest.raises(ValueError, match="integers"):
        manifest.build_manifest(*raw, ["1", "x"])


def test_summary(raw):
    assert manifest.summarize_build(*raw).first().asDict() == {
        "points_in": 4,
        "points_kept": 2,
        "points_dropped_invalid_image": 2,
        "sources_out": 2,
    }
    assert manifest.summarize_build(*raw, ["1"]).first()["points_in"] == 2


def test_write_and_read(raw, spark, tmp_path):
    ann, img = raw
    with pytest.raises(ValueError, match="empty manifest"):
        sinks.write_manifest(manifest.build_manifest(ann, img.limit(0)), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    path = str(tmp_path / "m")
    sinks.write_manifest(manifest.build_manifest(ann, img), path)
    read = tables.read_manifest(spark, path, site="s", bucket="b")
    assert rows(read, "project_id", "image_id", "label_id", "site", "bucket", "feature_vector") == [
        ("1", "a", "5", "s", "b", "s1/features/ia.featurevector"),
        ("2", "c", "7", "s", "b", "s2/features/ic.featurevector"),
    ]


def test_read_errors_name_path_and_columns(raw, spark, tmp_path):
    path = str(tmp_path / "m")
    raw[0].drop("label_id").write.parquet(path)
    with pytest.raises(RuntimeError, match="label_id") as caught:
        tables.read_manifest(spark, path)
    assert path in str(caught.value)
    with pytest.raises(RuntimeError, match="nowhere"):
        tables.read_manifest(spark, str(tmp_path / "nowhere"))


def test_other_column_names_and_blank_images(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame(
        [(1, "a", 1, 1, 9), (1, None, 1, 1, 9), (1, "", 1, 1, 9)],
        "source_id int, image_id string, row int, col int, their_label int",
    ).write.parquet(path)
    read = tables.read_manifest(spark, path, columns={"label_id": "their_label"})
    assert rows(read, "image_id", "label_id") == [("a", "9")]


def test_flagged_sources(spark):
    audit = spark.createDataFrame(
        [(1, True, True), (2, False, True), (3, True, False)],
        "source_id int, is_complete boolean, image_count_match boolean",
    )
    assert rows(tables.flagged_sources(audit)) == [(2,), (3,)]


def test_a_new_manifest_is_made_once(raw, tmp_path, monkeypatch):
    built = manifest.build_manifest(*raw)
    monkeypatch.setattr(type(built), "isEmpty", lambda self: pytest.fail("made once to look for rows"))
    sinks.write_manifest(built, str(tmp_path / "m"))
    assert built.sparkSession.read.parquet(str(tmp_path / "m")).count() == 2
