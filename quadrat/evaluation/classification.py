"""Precision, recall, F1, balanced accuracy and the multiclass correlation coefficient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.evaluation.confusion import marginals


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def label_scores(sides: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to a marginal table."""
    p = ratio(F.col("correct"), F.col("predicted"))
    r = ratio(F.col("correct"), F.col("support"))
    scored = sides.withColumn("precision", p).withColumn("recall", r)
    f1 = ratio(
        F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
    )
    return scored.withColumn("f1_score", f1)


def per_label(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Scores of every class in the list, classes that never occur with zeros."""
    sides = marginals(cells).withColumnRenamed("label", "class_id")
    every = classes.join(sides, "class_id", "left").na.fill(0, ["support", "predicted", "correct"])
    return label_scores(every).select(
        "class_name", "precision", "recall", "f1_score", F.col("support").alias("n_samples"), "class_id"
    )


def overall(cells: DataFrame) -> DataFrame:
    """One row: macro precision, recall and F1, balanced accuracy, MCC and accuracy.

    Macro averages run over labels in gt or est. This macro F1 is the harmonic mean of macro
    precision and macro recall.
    """
    scored = label_scores(marginals(cells))
    s, c = F.sum(F.col("support").cast("double")), F.sum(F.col("correct").cast("double"))
    pt = F.sum(F.col("predicted").cast("double") * F.col("support"))
    pp = F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    tt = F.sum(F.col("support").cast("double") * F.col("support"))
    one = scored.agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        ratio(c * s - pt, F.sqrt((s * s - pp) * (s * s - tt))).alias("mcc"),
        ratio(c, s).alias("accuracy"),
    )
    p, r = F.col("precision_macro"), F.col("recall_macro")
    return one.withColumn("f1_macro", ratio(F.lit(2.0) * p * r, p + r))


def accuracy_by(predictions: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Accuracy of each model on the same rows."""
    hit = (F.col("gt") == F.col("est")).cast("double")
    return predictions.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
