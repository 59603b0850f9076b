import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrat.operators import subsample as subsample_module
from quadrat.operators.allocate import SubsampleOptions, class_targets
from quadrat.operators.prepare import POINT_KEY
from quadrat.operators.ranking import exact_percentile, ranked
from quadrat.operators.subsample import audit, subsample
from quadrat.plans.dataset import DatasetOptions

from .conftest import rows

SIZES = (500, 200, 100, 50, 50, 30, 30, 20, 10, 10)


@pytest.fixture(scope="module")
def skewed(spark):
    data = [
        (f"a{c}", "" if c % 2 else "g", "s", f"p{i % 7}", f"i{i % 40}", i, c) for c, n in enumerate(SIZES) for i in range(n)
    ]
    random.Random(3).shuffle(data)
    return spark.createDataFrame(
        data, "attribute_id string, form_id string, site string, project_id string, image_id string, row int, col int"
    )


def brute_targets(strategy, total, floor, counts):
    """Rows dealt one decision at a time, the plain way."""
    n_all, k = sum(counts.values()), len(counts)
    share = {c: (round(total * n / n_all) if strategy == "stratified" else total // k) for c, n in counts.items()}
    out = {c: max(floor, min(n, share[c])) for c, n in counts.items()}
    if strategy == "stratified":
        for c in sorted(counts, key=lambda c: (-counts[c], c)):
            while sum(out.values()) > total and out[c] > floor:
                out[c] -= 1
    return out


@pytest.mark.parametrize("strategy", ["stratified", "balanced"])
def test_targets_match_brute_force(spark, strategy):
    rng = random.Random(7)
    for _ in range(6):
        counts = {(f"c{i}", rng.choice(["", "g"])): rng.randint(1, 400) for i in range(rng.randint(1, 12))}
        total, floor = rng.randint(1, sum(counts.values()) + 20), rng.choice([0, 0, 3, 30])
        table = spark.createDataFrame([(*k, n) for k, n in counts.items()], "attribute_id string, form_id string, n long")
        got = class_targets(SubsampleOptions(strategy, total, floor), table).collect()
        want = brute_targets(strategy, total, floor, counts)
        assert {(r["attribute_id"], r["form_id"]): r["target_n"] for r in got} == want


def test_option_checks():
    for bad in (
        {"strategy": "other", "total_annotations": 5},
        {"strategy": "balanced"},
        {"total_annotations": 0},
        {"total_annotations": 5, "min_per_class": -1},
    ):
        with pytest.raises(ValueError):
            SubsampleOptions(**bad)
    with pytest.raises(ValueError, match="no options called"):
        DatasetOptions.from_dict({"manifest_path": "x", "nope": 1})
    with pytest.raises(ValueError):
        DatasetOptions(manifest_path="x", included_csv="a", excluded_csv="b")
    with pytest.raises(ValueError):
        DatasetOptions()


def expected_rows(data, targets):
    kept = []
    for (a, f), n in targets.items():
        group = sorted(tuple(r[c] for c in POINT_KEY) for r in data if (r["attribute_id"], r["form_id"]) == (a, f))
        kept += [(a, f, *k) for k in group[:n]]
    return sorted(kept)


@pytest.mark.parametrize("options", [SubsampleOptions("stratified", 300, 5), SubsampleOptions("balanced", 400, 15)])
def test_same_rows_for_any_parallelism(spark, skewed, options):
    data = skewed.collect()
    counts = {}
    for r in data:
        counts[(r["attribute_id"], r["form_id"])] = counts.get((r["attribute_id"], r["form_id"]), 0) + 1
    want = expected_rows(data, brute_targets(options.strategy, options.total_annotations, options.min_per_class, counts))
    columns = ["attribute_id", "form_id", *POINT_KEY]
    kept, targets = subsample(skewed, options)
    assert rows(kept, *columns) == want
    audited = audit(targets, kept).collect()
    assert all(r["realized_n"] == min(r["target_n"], r["pre_count"]) for r in audited)
    try:
        for parts in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert rows(subsample(skewed.repartition(5), options)[0], *columns) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_classes_need_no_ranking(spark, skewed):
    kept, _ = subsample(skewed, SubsampleOptions("balanced", 10_000))
    assert kept.count() == sum(SIZES)
    assert "Window" not in kept._jdf.queryExecution().toString()


def test_ranks_over_chunks(spark, skewed):
    plain = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("attribute_id").orderBy(*POINT_KEY)))
    columns = ["attribute_id", *POINT_KEY, "rn"]
    assert rows(ranked(skewed, ["attribute_id"], POINT_KEY), *columns) == rows(plain, *columns)


def test_budget_beyond_bigint_products(spark):
    big = 10_000_000_000
    counts = spark.createDataFrame([("a", "", 3 * big), ("b", "", big)], "attribute_id string, form_id string, n long")
    targets = class_targets(SubsampleOptions("stratified", 2 * big), counts)
    assert rows(targets, "attribute_id", "target_n") == [("a", big * 3 // 2), ("b", big // 2)]
    halves = spark.createDataFrame([("a", "", 1), ("b", "", 3)], counts.schema)
    assert rows(class_targets(SubsampleOptions("stratified", 2), halves), "attribute_id", "target_n") == [("a", 0), ("b", 2)]


def test_ranks_with_null_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(6)] + [("a", i) for i in range(6)], "k string, i int")
    assert rows(ranked(df, ["k"], ["i"]).where("rn <> i + 1")) == []


def test_percentile_over_chunks(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(10)] + [(None,)], "x double")
    assert exact_percentile(df, "x", 0.5) == 20.5
    assert exact_percentile(df, "x", 1.0) == 81.0
    assert exact_percentile(df.where("x IS NULL"), "x", 0.5) is None


def test_only_the_source_at_the_cut_is_ranked(spark, skewed, monkeypatch):
    options = SubsampleOptions("balanced", 400, 15)
    columns = ["attribute_id", "form_id", *POINT_KEY]
    want = rows(subsample(skewed, options)[0], *columns)
    seen = []

    def counting(df, *rest):
        seen.append(df.count())
        return ranked(df, *rest)

    monkeypatch.setattr(subsample_module, "ranked", counting)
    assert rows(subsample(skewed, options)[0], *columns) == want
    # Seven sources a class, of which one is cut.
    assert 0 < sum(seen) <= sum(n // 7 + 1 for n in SIZES)


def test_sources_without_a_number_come_first(spark):
    data = [("a", "", "s", p, f"i{i}", i, 0) for i, p in enumerate([None] * 5 + ["p1"] * 5 + ["p2"] * 5)]
    points = spark.createDataFrame(
        data, "attribute_id string, form_id string, site string, project_id string, image_id string, row int, col int"
    )
    for total in (3, 5, 8, 15):
        kept, _ = subsample(points, SubsampleOptions("balanced", total))
        assert rows(kept, "row") == [(i,) for i in range(total)]
