"""Errors attributed to the taxonomy: common ancestors, branches and root categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.evaluation.classification import ratio
from quadrat.operators.taxonomy import lca

CROSS_BRANCH = "(cross-branch)"


def with_lca(cells: DataFrame, classes: DataFrame, errors_only: bool = True) -> DataFrame:
    """Wrong cells (or all) with the last common ancestor ``lca`` of their attributes."""
    a = classes.select(F.col("class_id").alias("gt"), F.col("path").alias("_gt_path"))
    b = classes.select(F.col("class_id").alias("est"), F.col("path").alias("_est_path"))
    if errors_only:
        cells = cells.where(F.col("gt") != F.col("est"))
    return cells.join(a, "gt").join(b, "est").withColumn("lca", lca(F.col("_gt_path"), F.col("_est_path"))).drop(
        "_gt_path", "_est_path"
    )


def branch_error_rates(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """One row: shares of errors across and within root branches, both 0 without errors."""
    cross = F.sum(F.when(F.col("lca").isNull(), F.col("n")).otherwise(0))
    within = F.sum(F.when(F.col("lca").isNotNull(), F.col("n")).otherwise(0))
    return with_lca(cells, classes).agg(
        ratio(cross, F.sum("n")).alias("cross_branch_error_rate"),
        ratio(within, F.sum("n")).alias("within_branch_error_rate"),
    )


def error_attribution(cells: DataFrame, classes: DataFrame, walked: DataFrame) -> DataFrame:
    """Errors per common ancestor, most errors first, with the model attributes at or below it."""
    counted = with_lca(cells, classes).groupBy("lca").agg(F.sum("n").alias("error_count"))
    below = (
        classes.select("attribute_id", F.explode("path").alias("lca"))
        .groupBy("lca")
        .agg(F.count_distinct("attribute_id").alias("classes_in_subtree"))
    )
    names = walked.select(F.col("id").alias("lca"), F.col("name").alias("lca_name"), "root")
    branches = walked.select(F.col("id").alias("root"), F.col("name").alias("branch"))
    total = F.sum("error_count").over(Window.partitionBy(F.lit(0)))
    return (
        counted.withColumn("pct_of_errors", F.col("error_count") / total * 100)
        .join(below, "lca", "left")
        .join(names, "lca", "left")
        .join(branches, "root", "left")
        .select(
            F.coalesce("lca", F.lit(CROSS_BRANCH)).alias("lca_node"),
            F.coalesce("lca_name", F.lit(CROSS_BRANCH)).alias("lca_name"),
            F.coalesce("branch", F.lit("")).alias("branch"),
            "error_count",
            "pct_of_errors",
            F.coalesce("classes_in_subtree", F.lit(0)).alias("classes_in_subtree"),
        )
        .orderBy(F.desc("error_count"), "lca_node")
    )


def branch_errors(attributed: DataFrame) -> DataFrame:
    """Error totals per branch with their share; cross-branch errors are one entry."""
    named = F.when(F.col("lca_node") == CROSS_BRANCH, CROSS_BRANCH).otherwise(F.col("branch"))
    totals = attributed.groupBy(named.alias("branch")).agg(F.sum("error_count").alias("error_count"))
    share = F.col("error_count") / F.sum("error_count").over(Window.partitionBy(F.lit(0)))
    return totals.withColumn("share", share).orderBy(F.desc("error_count"), "branch")


def top_lca(attributed: DataFrame, n: int = 15) -> DataFrame:
    """The entries that the attribution report displays."""
    return attributed.orderBy(F.desc("error_count"), "lca_node").limit(n)


def root_confusion(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Confusion between root categories with floored row percent.

    ``gt_position`` orders the categories by true frequency, those only predicted last.
    """
    a = classes.select(F.col("class_id").alias("gt"), F.col("root").alias("gt_root"), F.col("root_name").alias("true"))
    b = classes.select(
        F.col("class_id").alias("est"), F.col("root").alias("est_root"), F.col("root_name").alias("predicted")
    )
    rolled = (
        cells.join(a, "gt")
        .join(b, "est")
        .groupBy("gt_root", "true", "est_root", "predicted")
        .agg(F.sum("n").alias("sample_count"))
    )
    row_sum = F.sum("sample_count").over(Window.partitionBy("gt_root"))
    pct = F.floor(F.lit(100) * F.col("sample_count") / row_sum)
    return rolled.withColumn("row_normalized_pct", pct)


def root_order(rolled: DataFrame) -> DataFrame:
    """(root, name, support, position): by true frequency, then ids that are only predicted."""
    sides = F.array(
        F.struct(F.col("gt_root").alias("root"), F.col("true").alias("name"), F.col("sample_count").alias("t")),
        F.struct(F.col("est_root").alias("root"), F.col("predicted").alias("name"), F.lit(0).cast("long").alias("t")),
    )
    totals = rolled.select(F.inline(sides)).groupBy("root", "name").agg(F.sum("t").alias("support"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("support"), "root")
    return totals.withColumn("position", F.row_number().over(order))


def root_confusions(rolled: DataFrame) -> DataFrame:
    """Confused category pairs, largest row percentage first."""
    return (
        rolled.where(F.col("gt_root") != F.col("est_root"))
        .select("true", "predicted", "row_normalized_pct", "sample_count")
        .orderBy(F.desc("row_normalized_pct"), "true", "predicted")
    )


def only_predicted(rolled: DataFrame) -> DataFrame:
    """Categories that are predicted but never true."""
    return (
        rolled.select(F.col("est_root").alias("root"))
        .distinct()
        .join(rolled.select(F.col("gt_root").alias("root")).distinct(), "root", "left_anti")
    )
