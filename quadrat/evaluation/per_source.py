"""Validation metrics by data source, from the confusion table grouped by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.evaluation.classification import label_scores, ratio
from quadrat.evaluation.confusion import POINTS, confusion, counted, marginals
from quadrat.evaluation.hierarchy import with_lca
from quadrat.functions.keys import source_key, source_parts
from quadrat.functions.numbers import half_even
from quadrat.operators.staging import pin


def attach_sources(predictions: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``source_key`` from an image table (image_key, site, project_id); unknown images get NULL."""
    lookup = images.select("image_key", source_key("site", "project_id").alias("source_key"))
    return predictions.join(lookup, "image_key", "left")


def source_scores(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """Unrounded metrics per source. This macro F1 is the mean of the labels' F1.

    Predictions are read once: they are counted by source, image and cell, and everything else starts from the counts.
    """
    if POINTS not in predictions.columns:
        predictions = pin(counted(predictions))
    cells = with_lca(confusion(predictions, ["source_key"]), classes, errors_only=False)
    wrong = F.col("gt") != F.col("est")
    errors = F.when(wrong, F.col("n")).otherwise(0)
    cross = F.when(wrong & F.col("lca").isNull(), F.col("n")).otherwise(0)
    marked = cells.withColumn("errors", errors).withColumn("cross", cross)
    scored = label_scores(marginals(marked, ["source_key"], ["errors", "cross"]))
    per_source = scored.groupBy("source_key").agg(
        F.sum("support").alias("num_val_annotations"),
        ratio(F.sum("cross"), F.sum("errors")).alias("cross_branch_error_rate"),
        (F.sum("correct") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1_score").alias("f1_macro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )
    images = predictions.groupBy("source_key").agg(
        F.count_distinct("image_key").alias("num_val_images")
    )
    return per_source.join(images, "source_key")


def per_source(scores: DataFrame) -> DataFrame:
    """The report table: four decimals, most annotated source first."""
    parts = source_parts("source_key")
    rounded = [
        half_even(F.col(c), 4).alias(c)
        for c in (
            "accuracy",
            "balanced_accuracy",
            "f1_macro",
            "precision_macro",
            "recall_macro",
            "cross_branch_error_rate",
        )
    ]
    return scores.select(
        "source_key",
        parts["site"].alias("site"),
        parts["source_id"].alias("source_id"),
        "num_val_images",
        "num_val_annotations",
        *rounded,
    ).orderBy(F.desc("num_val_annotations"), "source_key")


def source_range(scores: DataFrame) -> DataFrame:
    """One row: number of sources, smallest and largest source accuracy."""
    return scores.agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.min("accuracy").alias("min_accuracy"),
        F.max("accuracy").alias("max_accuracy"),
    )
