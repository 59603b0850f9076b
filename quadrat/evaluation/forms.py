"""How well forms are told apart, among rows whose true class has a form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.evaluation.classification import label_scores
from quadrat.evaluation.confusion import marginals
from quadrat.functions.keys import NO_FORM
from quadrat.functions.numbers import half_even

NO_FORM_NAME = "(no GF)"


def form_cells(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Cells whose true class has a form: form names and whether the attribute is right."""

    def side(key: str) -> DataFrame:
        name = F.when(F.col("form_id") == NO_FORM, NO_FORM_NAME).otherwise(F.col("form_name"))
        return classes.select(
            F.col("class_id").alias(key), F.col("attribute_id").alias(f"_{key}_attr"), name.alias(f"{key}_form")
        )

    joined = cells.join(side("gt"), "gt").join(side("est"), "est")
    return joined.where(F.col("gt_form") != NO_FORM_NAME).select(
        F.col("gt_form").alias("gt"),
        F.col("est_form").alias("est"),
        (F.col("_gt_attr") == F.col("_est_attr")).alias("same_attribute"),
        "n",
    )


def form_accuracy(formed: DataFrame) -> DataFrame:
    """One row: form accuracy, and the same where the attribute is right.

    Without relevant rows both are 0; without a right attribute the second is NaN.
    """
    right = F.col("gt") == F.col("est")
    all_n = F.sum("n")
    inner_n = F.sum(F.when(F.col("same_attribute"), F.col("n")).otherwise(0))
    inner_hit = F.sum(F.when(F.col("same_attribute") & right, F.col("n")).otherwise(0))
    hit = F.sum(F.when(right, F.col("n")).otherwise(0))
    return formed.agg(
        F.coalesce(F.try_divide(hit, all_n), F.lit(0.0)).alias("gf_accuracy_gf_relevant"),
        F.when(all_n.isNull(), F.lit(0.0))
        .otherwise(F.coalesce(F.try_divide(inner_hit, inner_n), F.lit(float("nan"))))
        .alias("within_ba_gf_accuracy"),
    )


def form_scores(formed: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per true form, most frequent first."""
    scored = label_scores(marginals(formed)).where(F.col("support") > 0)
    return scored.select(
        F.col("label").alias("growth_form"),
        half_even(F.col("precision")).alias("precision"),
        half_even(F.col("recall")).alias("recall"),
        half_even(F.col("f1_score")).alias("f1"),
        "support",
    ).orderBy(F.desc("support"), "growth_form")


def form_confusion(formed: DataFrame) -> DataFrame:
    """Floored row percent over the true forms and ``(no GF)``; other predictions do not count."""
    columns = formed.select(F.col("gt").alias("est")).distinct()
    inside = formed.join(
        columns.union(columns.sparkSession.createDataFrame([(NO_FORM_NAME,)], "est string")),
        "est",
        "left_semi",
    )
    cells = inside.groupBy("gt", "est").agg(F.sum("n").alias("n"))
    row_sum = F.sum("n").over(Window.partitionBy("gt"))
    return cells.withColumn("pct", F.floor(F.lit(100) * F.col("n") / row_sum))
