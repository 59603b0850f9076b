import pytest
from pyspark.sql import functions as F

from quadrat.evaluation import ranking
from quadrat.operators import rollup_builder, taxonomy

from .conftest import rows


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(
        [("A", "a", None), ("A1", "zz", "A"), ("A2", "bb", "A"), ("B", "b", None), ("B1", "b1", "B"), ("A1x", "a1x", "A1"), ("A1xy", "deep", "A1x"), ("A1xz", "deep2", "A1x")],
        "id string, name string, parent string",
    )


@pytest.fixture(scope="module")
def walked(nodes):
    return taxonomy.paths(nodes)


def test_paths_ancestors_descendants(walked):
    paths = {r["id"]: (list(r["path"]), r["root"]) for r in walked.collect()}
    assert paths["A1xy"] == (["A", "A1", "A1x", "A1xy"], "A")
    assert paths["B"] == (["B"], "B")
    up = taxonomy.ancestors(walked).where("id = 'A1xy'").orderBy("position")
    assert [r["ancestor"] for r in up.collect()] == ["A", "A1", "A1x"]
    below = taxonomy.descendants(walked).where("ancestor = 'A'").collect()
    assert [r["id"] for r in below] == ["A2", "A1", "A1x", "A1xy", "A1xz"]
    assert taxonomy.descendants(walked).where("ancestor = 'B1'").count() == 0
    assert rows(taxonomy.roots(walked).where("id = 'A1x'"), "id", "root", "root_name") == [("A1x", "A", "a")]


@pytest.mark.parametrize(
    "a, b, lca, similarity",
    [("A1", "A1", "A1", 1.0), ("A1", "A2", "A", 0.5), ("A1xy", "A1xz", "A1x", 0.75), ("A", "A1", "A", 0.5), ("A1", "B1", None, 0.0)],
)
def test_lca_and_similarity(walked, a, b, lca, similarity):
    two = walked.select(F.col("id").alias("x"), F.col("path").alias("px")).where(F.col("x") == a)
    other = walked.select(F.col("id").alias("y"), F.col("path").alias("py")).where(F.col("y") == b)
    one = two.join(other, F.lit(True)).select(
        taxonomy.lca(F.col("px"), F.col("py")), taxonomy.similarity(F.col("px"), F.col("py"))
    ).first()
    assert tuple(one) == (lca, similarity)


def test_cycles_and_unknown_parents(spark):
    schema = "id string, name string, parent string"
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.paths(spark.createDataFrame([("A", "a", None), ("x", "x", "y"), ("y", "y", "x")], schema))
    with pytest.raises(ValueError, match="unknown parent"):
        taxonomy.paths(spark.createDataFrame([("A", "a", None), ("x", "x", "gone")], schema))
    with pytest.raises(ValueError, match="no root"):
        taxonomy.paths(spark.createDataFrame([("x", "x", "gone")], schema))


def test_class_table(spark, walked):
    keys = spark.createDataFrame([("A1::",), ("A2::g1",), ("A1::",)], "class_id string")
    forms = spark.createDataFrame([("g1", "G one")], "id string, name string")
    table = taxonomy.class_table(taxonomy.class_list(keys), walked, forms)
    assert rows(table, "idx", "class_id", "class_name", "root_name") == [
        (0, "A1::", "zz", "a"),
        (1, "A2::g1", "bb::G one", "a"),
    ]
    for bad in ("A2::other", "nope::"):
        listed = taxonomy.class_list(spark.createDataFrame([(bad,)], "class_id string"))
        with pytest.raises(ValueError, match="not in the taxonomy"):
            taxonomy.class_table(listed, walked, forms)
    sims = {r["gt_idx"]: list(r["sims"]) for r in ranking.similarity_rows(table).collect()}
    assert sims == {0: [1.0, 0.5], 1: [0.5, 1.0]}


def test_rollup_builder(spark, walked, nodes):
    forms = spark.createDataFrame([("f1", "Branching"), ("f2", "Massive"), ("f3", "Foliose")], "id string, name string")
    labels = spark.createDataFrame(
        [("A1", "zz", 1, "branching, massive"), ("A1x", "a1x", 0, "massive"), ("A2", "bb", None, None), ("Q", "ghost", 1, ""), ("B", "b", 1, None)],
        "id string, name string, top100 int, `growth forms` string",
    )
    flagged = rollup_builder.flagged_names(labels)
    targets, unresolved, excluded = rollup_builder.resolve_targets(flagged, nodes, ("b",))
    assert rows(targets) == [("A1",)] and rows(unresolved) == [("ghost",)] and rows(excluded) == [("b",)]
    mapping = spark.createDataFrame(
        [
            ("1", "A1", "f1"), ("2", "A1", None), ("3", "A1xy", ""), ("4", "A1x", ""), ("5", "A1x", "f2"),
            ("6", "A1x", "f3"), ("7", "A2", "f1"), ("8", None, ""), ("9", "nope", ""), ("10", "B", ""), ("11", "A1x", "f2"),
            ("12", "A1", "f3"),
        ],
        "provider_id string, attribute_id string, form_id string",
    )
    done = rollup_builder.classify_mapping(
        mapping, walked, forms, targets, rollup_builder.excluded_ids(nodes, ("b",)), "A1",
        rollup_builder.inherent_forms(labels),
    )
    assert {r["reason"]: r["entries"] for r in rollup_builder.drop_reasons(done).collect()} == {
        "null": 1, "unknown": 1, "excluded": 1, "no_target": 1,
    }
    built = rollup_builder.rollup_rows(done)
    assert rows(built.drop("to_form_name")) == [
        ("A1", "f3", "A1", ""),
        ("A1x", "", "A1", "f2"),  # inherent form of the attribute
        ("A1x", "f2", "A1", "f2"),
        ("A1x", "f3", "A1", ""),
        ("A1xy", "", "A1", ""),
    ]
    assert rollup_builder.rollup_breakdown(built, "A1").first().asDict() == {
        "form_collapse": 1, "cross_attribute": 4, "designated_form_collapse": 1,
        "designated_to_branching": 0, "designated_to_massive": 2, "designated_to_other": 2,
    }
    included = rollup_builder.included_rows(targets, forms, "A1")
    assert rows(included) == [("A1", ""), ("A1", "f1"), ("A1", "f2")]
    rollup_builder.require_inside(built, included)
    with pytest.raises(ValueError, match="not included"):
        rollup_builder.require_inside(built, included.limit(0))
    plain = rollup_builder.classify_mapping(mapping, walked, forms, targets, nodes.select("id").limit(0))
    assert rows(rollup_builder.rollup_rows(plain).where("to_form_id <> ''")) == []
