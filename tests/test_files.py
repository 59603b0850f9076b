import gzip
import io
import json

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from quadrat.functions.keys import provider_feature_path
from quadrat.operators.allocate import SubsampleOptions
from quadrat.operators.staging import staging_scope
from quadrat.plans.dataset import DatasetOptions, build_dataset, publish
from quadrat.sources import exports, sinks, source_files, tables

from .conftest import rows


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    put(root, "s1/annotations.csv", "Row,Column,Label ID,Image ID\n1,2,9,77\n3,4,9,78\n")
    put(root, "s2/annotations.csv", "Name,Row,Column,Label ID\na.JPG,5,6,8\nb.JPG,7,8,8\n c.JPG ,9,9,8\n")
    put(root, "s2/image_list.csv", "Name,Image Page,Image URL\na.JPG - Confirmed,/image/500/view/,u\nc.JPG -  Unconfirmed,/image/501/view/,u\na.JPG - Unclassified,/image/502/view/,u\nd.JPG,/nothing/,u\n")
    put(root, "s3/annotations.csv", "Row,Column,Image ID\n1,2,3\n")
    put(root, "s4/annotations.csv", "Row,Column,Label ID\n1,2,3\n")
    put(root, "s5/annotations.csv", 'Row,"Column","Label ID","Image ID","Note, long"\n8,9,4,90,"a, b"\n')
    put(root, "s1/features/i77.featurevector", "x")
    return root


def test_source_files(spark, sources):
    annotations, skipped = source_files.read_source_annotations(spark, f"{sources}/s*/annotations.csv")
    assert rows(skipped) == [("3", "missing_columns"), ("4", "no_image_column")]
    names = source_files.read_image_lists(spark, f"{sources}/s*/image_list.csv")
    assert rows(names, "name_norm", "image_id") == [("a.JPG", "502"), ("c.JPG", "501")]
    resolved = source_files.resolve_images(annotations, names)
    assert rows(source_files.mapped_rows(resolved), "source_id", "image_id", "Row") == [
        ("1", "77", "1"), ("1", "78", "3"), ("2", "501", "9"), ("2", "502", "5"), ("5", "90", "8"),
    ]
    assert rows(source_files.unmapped_counts(resolved)) == [("1", 2, 0), ("2", 3, 1), ("5", 1, 0)]
    # Only rows that need it meet the name table.
    assert resolved._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        piece = super().read(n)
        self.taken += len(piece)
        return piece


def test_first_lines_are_bounded(spark, tmp_path):
    for text, want in (
        (b"", None), (b"\n1", ""), (b"a,b", "a,b"), (b"a,b\r\n1", "a,b"), (b"a,b\r1,2", "a,b"),
        (b"\xef\xbb\xbfR\xc3\xa4,b\nx", "R\u00e4,b"),
    ):
        assert source_files.first_line(Counted(text)) == want
    large = Counted(b"Row,Column\n" + b"1,2\n" * 5_000_000)
    assert source_files.first_line(large) == "Row,Column" and large.taken == source_files.HEAD_BYTES
    wide = ",".join(f"c{i}" for i in range(20_000))
    longer = Counted((wide + "\n").encode() + b"1\n" * 5_000_000)
    assert source_files.first_line(longer) == wide and longer.taken < len(wide) + 2 * source_files.HEAD_BYTES

    put(tmp_path, "s1/annotations.csv", "Row,Column\n1,2\n")
    put(tmp_path, "s2/annotations.csv", "")
    put(tmp_path, "s b/annotations.csv", "Row\n")
    put(tmp_path, "s4/annotations.csv", "Name,Row")
    glob = f"{tmp_path}/s*/annotations.csv"
    heads = source_files.read_first_lines(spark, glob)
    assert rows(heads, "source_id", "header") == [("%20b", "Row"), ("1", "Row,Column"), ("4", "Name,Row")]
    # The listing takes no content; the scan of all lines agrees, as does a file system that is given.
    assert "ReadSchema: struct<path:string>" in heads._jdf.queryExecution().executedPlan().toString()
    assert rows(source_files.scan_first_lines(spark, glob), "source_id", "header") == rows(heads, "source_id", "header")
    assert rows(source_files.read_first_lines(spark, glob, fs.LocalFileSystem())) == rows(heads)
    assert source_files.place("s3a://bucket/a/b c.csv") == "bucket/a/b c.csv"
    assert source_files.place("hdfs://host:8020/a/b.csv") == "/a/b.csv"
    assert source_files.place("file:/a/b.csv") == source_files.place("file:///a/b.csv") == "/a/b.csv"
    with gzip.open(tmp_path / "z.csv.gz", "wb") as out:
        out.write(b"Row,Column\n1,2\n")
    assert [r["header"] for r in source_files.read_first_lines(spark, f"{tmp_path}/z.csv.gz").collect()] == ["Row,Column"]


def test_feature_listing(spark, sources):
    listing = tables.list_feature_files(spark, str(sources), "*.featurevector")
    assert listing.count() == 1
    # The file contents stay unread.
    assert "ReadSchema: struct<path:string>" in listing._jdf.queryExecution().executedPlan().toString()
    assert rows(tables.existing_images(listing)) == [("1", "77")]


def test_exports(spark, tmp_path):
    put(tmp_path, "taxonomy.json", json.dumps({"results": [{"id": "a", "name": "A", "parent": None}, {"id": "b", "name": "B", "parent": "a"}]}, indent=1))
    assert rows(exports.read_taxonomy(spark, str(tmp_path / "taxonomy.json")).where("parent IS NOT NULL")) == [("b", "B", "a")]
    put(tmp_path, "choices.json", json.dumps([{"name": "x", "data": []}, {"name": "growthforms", "data": [{"id": "g", "name": "G"}]}], indent=1))
    assert rows(exports.read_forms(spark, str(tmp_path / "choices.json"))) == [("g", "G")]
    with pytest.raises(ValueError, match="no list 'other'"):
        exports.read_forms(spark, str(tmp_path / "choices.json"), "other")
    entry = {"provider_id": "1", "provider_label": "L", "benthic_attribute_id": "a", "benthic_attribute_name": "A", "growth_form_id": None, "growth_form_name": None}
    put(tmp_path, "map.json", json.dumps({"results": [entry, {**entry, "benthic_attribute_id": "b"}]}, indent=1))
    assert rows(exports.read_label_mapping(spark, str(tmp_path / "map.json")), "provider_id", "attribute_id", "form_id") == [("1", "b", "")]
    for first, second in ((1, 4000), (4000, 1)):  # the later page wins, however large either file is
        folder = tmp_path / f"pages{first}"
        fill = [{**entry, "provider_id": f"x{k}"} for k in range(first)]
        put(folder, "page1.json", json.dumps({"results": [*fill, {**entry, "benthic_attribute_id": "FIRST"}]}))
        more = [{**entry, "provider_id": f"y{k}"} for k in range(second)]
        put(folder, "page2.json", json.dumps({"results": [{**entry, "benthic_attribute_id": "SECOND"}, *more]}))
        read = exports.read_label_mapping(spark, str(folder)).where("provider_id = '1'")
        assert rows(read, "attribute_id") == [("SECOND",)]


def test_points_and_wide_predictions(spark, tmp_path):
    put(tmp_path, "p.csv", "row,column,remark\n5,6,z\n1,2,y\n")
    points = exports.read_points(spark, str(tmp_path / "p.csv"))
    assert rows(points) == [(1, 2, "None", None), (5, 6, "None", None)]
    given = spark.read.csv(str(tmp_path / "p.csv"), header=True).withColumn("_o", F.monotonically_increasing_id())
    ranked = spark.createDataFrame(
        [("5", "6", 1, "a::", 0.75), ("5", "6", 2, "b::", 0.25), ("1", "2", 1, "b::", 0.99999)],
        "row string, column string, rank int, label string, score double",
    )
    wide = sinks.wide_predictions(given, ranked, 2, "_o")
    assert wide.columns == ["row", "column", "label", "score", "label2", "score2", "remark"]
    assert [tuple(r) for r in wide.collect()] == [
        ("5", "6", "a::", "0.7500", "b::", "0.2500", "z"),
        ("1", "2", "b::", "1.0000", None, None, "y"),
    ]


def test_sources_are_skipped_one_by_one(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([("1", "a")], "source_id string, v string")
    sinks.write_annotations_by_source(one, path)
    sinks.write_annotations_by_source(one.withColumn("v", F.lit("b")), path)
    assert rows(spark.read.csv(path, header=True), "v") == [("a",)]
    both = one.withColumn("v", F.lit("c")).union(spark.createDataFrame([("2", "d")], one.schema))
    sinks.write_annotations_by_source(both, path)
    assert rows(spark.read.csv(path, header=True), "source_id", "v") == [(1, "a"), (2, "d")]
    named = spark.createDataFrame([("3", "5", None)], "source_id string, image_id string, `Image ID` string")
    sinks.write_annotations_by_source(named, str(tmp_path / "ids"))
    assert rows(spark.read.csv(str(tmp_path / "ids"), header=True), "Image ID", "source_id") == [("5", 3)]


def test_dataset_build(spark, tmp_path):
    spark.createDataFrame(
        [(1 + i % 2, f"{i // 5}", i, i, 5 if i % 3 else 6) for i in range(60)] + [(1, "0", 99, 99, 404)],
        "source_id int, image_id string, row int, col int, label_id int",
    ).write.parquet(str(tmp_path / "m"))
    spark.createDataFrame(
        [(f"n{i}", i, i, "a1", "None") for i in range(20)],
        "image_id string, row int, col int, attribute_id string, form_id string",
    ).write.parquet(str(tmp_path / "n"))
    mapping = spark.createDataFrame(
        [("5", "L", "a1", ""), ("6", "M", "a2", "g")], "provider_id string, provider_label string, attribute_id string, form_id string"
    )
    put(tmp_path, "roll.csv", "from_ba_id,from_gf_id,to_ba_id,to_gf_id\na2,g,a2,\n")
    put(tmp_path, "in.csv", "ba_id,gf_id\na1,\na2,\n")
    options = DatasetOptions(
        manifest_path=str(tmp_path / "m"), native_path=str(tmp_path / "n"), rollup_csv=str(tmp_path / "roll.csv"),
        included_csv=str(tmp_path / "in.csv"), subsample=SubsampleOptions("balanced", 60), percent_missing_allowed=10,
        annotations_to_log="s1",
    )
    images = spark.read.parquet(str(tmp_path / "m")).select(
        F.concat(F.lit("features/"), provider_feature_path(F.col("source_id"), F.col("image_id"))).alias("feature_full")
    )
    listing = images.union(spark.createDataFrame([(f"native-features/native/n{i}_featurevector",) for i in range(1, 20)], "feature_full string"))
    names = spark.createDataFrame([("a1", "A one"), ("a2", "A two")], "id string, name string")
    data = build_dataset(spark, options, mapping, listing, names, names.limit(0))
    one = data.tables["retention"].first()
    assert (one["annotations_before"], one["annotations_filter"]) == (80, 80)
    assert rows(data.tables["unmapped_labels"]) == [("404", 1, 1)]
    audited = {r["attribute_id"]: r for r in data.tables["subsample_audit"].collect()}
    assert audited["a1"]["pre_count"] == 60 and audited["a1"]["realized_n"] == 30 and audited["a2"]["realized_n"] == 20
    # The native site sorts first, so its point without a feature file is in the sample and drops out.
    assert data.annotations.count() == 49
    counts = {r["attribute_name"]: (r["num_annotations"], r["ref"], r["val"]) for r in data.tables["class_counts"].collect()}
    assert counts == {"A one": (29, 2, 2), "A two": (20, 2, 2)}
    assert data.tables["train_summary"].first()["annotations"] == 49
    publish({k: data.tables[k] for k in ("class_counts", "train_summary")}, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report/class_counts"), header=True).count() == 2


def test_annotations_are_written_without_a_copy(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "source_id string, v string")
    with staging_scope(spark) as scope:
        sinks.write_annotations_by_source(df, str(tmp_path / "one"))
        assert scope.folders == []
    assert spark.read.csv(str(tmp_path / "one"), header=True).count() == 2
