"""Confusion counts. Every label metric starts from this table, so prediction rows are read once.

Predictions: ``gt`` and ``est`` class keys, with ``image_key``, ``source_key`` and ``score`` where a
metric needs them. Classes: the pinned class table of ``operators.taxonomy.class_table``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


POINTS = "n_points"


def counted(predictions: DataFrame, by: Sequence[str] = ("source_key", "image_key")) -> DataFrame:
    """(by..., gt, est, n_points): predictions that are alike in one row, from which all counting metrics can start."""
    return predictions.groupBy(*by, "gt", "est").agg(F.count(F.lit(1)).alias(POINTS))


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., gt, est, n), only the cells that occur. Takes predictions or ``counted`` ones."""
    n = F.sum(POINTS) if POINTS in predictions.columns else F.count(F.lit(1))
    return predictions.groupBy(*by, "gt", "est").agg(n.alias("n"))


def marginals(cells: DataFrame, by: Sequence[str] = (), carried: Sequence[str] = ()) -> DataFrame:
    """(by..., label, support, predicted, correct) for labels in gt or est, in one aggregation.

    ``carried`` columns are further counts of a cell; their sums go to the true label.
    """
    none = F.lit(0).cast("long")
    hit = F.when(F.col("gt") == F.col("est"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(
            F.col("gt").alias("label"), F.col("n").alias("t"), none.alias("p"), hit.alias("c"), *carried
        ),
        F.struct(
            F.col("est").alias("label"),
            none.alias("t"),
            F.col("n").alias("p"),
            none.alias("c"),
            *[none.alias(c) for c in carried],
        ),
    )
    return (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(
            F.sum("t").alias("support"),
            F.sum("p").alias("predicted"),
            F.sum("c").alias("correct"),
            *[F.sum(c).alias(c) for c in carried],
        )
    )


def class_grid(classes: DataFrame) -> DataFrame:
    """All (gt, est) pairs of the class list: K rows, each unfolded over the K classes."""
    every = F.collect_list("class_id").over(Window.partitionBy(F.lit(0)))
    return classes.select("class_id", every.alias("_all")).select(
        F.col("class_id").alias("gt"), F.explode("_all").alias("est")
    )


def full_confusion(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Every cell of the K x K matrix, empty ones as 0, with the floored row percentage."""
    row_sum = F.sum("n").over(Window.partitionBy("gt"))
    full = class_grid(classes).join(cells, ["gt", "est"], "left").select(
        "gt", "est", F.coalesce("n", F.lit(0)).alias("n")
    )
    return full.select(
        "gt",
        "est",
        "n",
        F.coalesce(F.floor(F.try_divide(F.lit(100) * F.col("n"), row_sum)), F.lit(0)).alias("pct"),
    )


def wide_confusion(full: DataFrame, classes: DataFrame, value: str = "n") -> DataFrame:
    """One row per true class, one column per predicted class, ordered by (root, name).

    The columns carry the display names, so two classes of one name are refused.
    """
    order = classes.orderBy("root_name", "class_name").select("class_id", "class_name").collect()
    names = [r["class_name"] for r in order]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"Several classes are called {twice[:3]}, so a wide table cannot tell them apart.")
    wide = full.groupBy("gt").pivot("est", [r["class_id"] for r in order]).agg(F.first(value))
    named = classes.select(F.col("class_id").alias("gt"), "class_name", "root_name")
    return (
        wide.join(named, "gt")
        .orderBy("root_name", "class_name")
        .select(
            F.col("class_name").alias("-"),
            *[F.col(f"`{r['class_id']}`").alias(r["class_name"]) for r in order],
        )
    )


def profile_distances(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Cosine distance of the prediction profiles of each pair of classes (gt_a < gt_b).

    A profile is a row of the confusion matrix divided by its total; a class without rows has
    distance 1 to every other class.
    """
    share = F.col("n") / F.sum("n").over(Window.partitionBy("gt"))
    rows = cells.select("gt", "est", share.alias("share"))
    norms = rows.groupBy("gt").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("norm"))
    scaled = rows.join(norms, "gt").select("gt", "est", (F.col("share") / F.col("norm")).alias("unit"))
    a = scaled.select(F.col("gt").alias("gt_a"), "est", F.col("unit").alias("ua"))
    b = scaled.select(F.col("gt").alias("gt_b"), "est", F.col("unit").alias("ub"))
    shared = (
        a.join(b, "est")
        .where(F.col("gt_a") < F.col("gt_b"))
        .groupBy("gt_a", "gt_b")
        .agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine"))
    )
    pairs = class_grid(classes).select(F.col("gt").alias("gt_a"), F.col("est").alias("gt_b"))
    pairs = pairs.where(F.col("gt_a") < F.col("gt_b"))
    return pairs.join(shared, ["gt_a", "gt_b"], "left").select(
        "gt_a", "gt_b", (F.lit(1.0) - F.coalesce("cosine", F.lit(0.0))).alias("distance")
    )
