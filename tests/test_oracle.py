"""Registered queries against DuckDB on the smallest test tables.

Every one by default; QUADRAT_ORACLE=section runs a cross-section.
"""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from quadrat.checks.oracle import connect, differences
from quadrat.checks.registry import QUERIES

SF = os.environ.get("QUADRAT_ORACLE_SF", "/root/testdata/sf0.001")
SECTION = [
    "manifest_join",
    "manifest_summary",
    "labels_mapped",
    "retention",
    "stratified_targets_trimmed",
    "subsample_balanced",
    "missing_feature_counts",
    "extraction_work",
    "split_rows",
    "class_weight_summary",
    "taxonomy_lca",
    "rollup_mapping_classified",
    "confusion_matrix",
    "overall_scores",
    "error_attribution",
    "form_scores",
    "calibration_bins",
    "cover_by_class",
    "per_source_scores",
    "hierarchical_topk",
    "head_scores",
    "run_early_stopping",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SECTION if os.environ.get("QUADRAT_ORACLE") == "section" else list(QUERIES))
def test_query(spark, con, name):
    fn, sql = QUERIES[name]
    if sql is None:
        assert fn(spark, SF).count() > 0
        return
    # On the smallest tables a query may rightly find nothing, on both sides.
    assert [p for p in differences(spark, con, SF, fn, sql) if p != "no rows"] == []


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
