"""Log loss and weighted cross entropy from probability rows.

``probs``: one row per sample with ``gt_idx`` (position in the class list) and ``proba``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.numbers import CATEGORY_EPS, LIBRARY_EPS
from quadrat.operators.taxonomy import by_root


def p_true() -> Column:
    return F.get("proba", F.col("gt_idx"))


def log_loss(probs: DataFrame) -> DataFrame:
    """Mean negative log probability of the true class, clipped as the library does."""
    clipped = F.least(F.greatest(p_true(), F.lit(LIBRARY_EPS)), F.lit(1.0 - LIBRARY_EPS))
    return probs.agg(F.avg(-F.ln(clipped)).alias("log_loss"))


def category_log_loss(probs: DataFrame, classes: DataFrame, min_samples: int = 30) -> DataFrame:
    """Log loss per root category (its own clip), largest first."""
    clipped = F.least(F.greatest(p_true(), F.lit(CATEGORY_EPS)), F.lit(1.0))
    named = with_class(probs, classes)
    table = by_root(named, classes, F.avg(-F.ln(clipped)).alias("log_loss"), min_samples=min_samples)
    return table.select("category", "log_loss", "n_samples").orderBy(F.desc("log_loss"), "category")


def with_class(probs: DataFrame, classes: DataFrame) -> DataFrame:
    """Add the class key ``gt`` of ``gt_idx``."""
    return probs.join(classes.select(F.col("idx").alias("gt_idx"), F.col("class_id").alias("gt")), "gt_idx")


def encode_labels(samples: DataFrame, classes: DataFrame, label: str = "gt") -> DataFrame:
    """Add ``gt_idx``, the position of the label in the sorted class list."""
    lookup = classes.select(F.col("class_id").alias(label), F.col("idx").alias("gt_idx"))
    return samples.join(lookup, label, "left")


def unknown_labels(samples: DataFrame, classes: DataFrame, label: str = "gt") -> DataFrame:
    """Labels that the class list lacks; encoding must not go on when there are any."""
    return (
        samples.select(label)
        .distinct()
        .join(classes.select(F.col("class_id").alias(label)), label, "left_anti")
    )


def require_known_labels(samples: DataFrame, classes: DataFrame, label: str = "gt") -> None:
    bad = [r[0] for r in unknown_labels(samples, classes, label).orderBy(label).limit(20).collect()]
    if bad:
        raise ValueError(f"Labels {bad} are not in the class list.")


def check_weights(classes: DataFrame, weights: DataFrame) -> None:
    """Weights must cover every class and be non-negative."""
    joined = classes.select("class_id").join(weights, "class_id", "left")
    bad = joined.where(F.col("weight").isNull() | (F.col("weight") < 0)).orderBy("class_id").limit(20)
    found = [r["class_id"] for r in bad.collect()]
    if found:
        raise ValueError(f"Class weights are missing or negative for {found}.")


def weighted_cross_entropy(probs: DataFrame, classes: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of w * -ln p over sum of w, with the weight of the true class."""
    named = with_class(probs, classes).join(weights.withColumnRenamed("class_id", "gt"), "gt")
    loss = F.sum(F.col("weight") * -F.ln(p_true())) / F.sum("weight")
    return named.agg(loss.alias("weighted_cross_entropy"))
