"""Per-image cover: share of an image's points in each class, true against predicted.

Cover is kept sparse. A class that an image has neither as truth nor as prediction contributes 0,
which the sums already say once they are divided by the number of all images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.evaluation.confusion import POINTS

SIGNIFICANT_PCT = 0.5


def image_cover(predictions: DataFrame) -> DataFrame:
    """(image_key, class_id, true_share, pred_share, first): ``first`` marks one row per image. Takes ``counted`` predictions too.

    Points are counted per (image, class) before an image's rows meet, so even an image that holds
    a large part of all points reaches its window with one row per class. Counted ones are few per image already, one row for each pair of classes at most,
    and meet by image once.
    """
    n = F.col(POINTS) if POINTS in predictions.columns else F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("gt").alias("class_id"), n.alias("t"), none.alias("p")),
        F.struct(F.col("est").alias("class_id"), none.alias("t"), n.alias("p")),
    )
    if POINTS in predictions.columns:
        predictions = predictions.repartition("image_key")
    counts = (
        predictions.select("image_key", F.inline(sides))
        .groupBy("image_key", "class_id")
        .agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    )
    image = Window.partitionBy("image_key")
    points = F.sum("t").over(image)
    return counts.select(
        "image_key",
        "class_id",
        (F.col("t") / points).alias("true_share"),
        (F.col("p") / points).alias("pred_share"),
        (F.row_number().over(image.orderBy("class_id")) == 1).cast("long").alias("first"),
    )


def cover_by_class(predictions: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Per class in gt or est: mean true cover, bias, RMSE, MAE (percent) and R-squared.

    R-squared is NaN when the true cover is the same in all images.
    """
    err = F.col("pred_share") - F.col("true_share")
    sums = image_cover(predictions).groupBy("class_id").agg(
        F.sum("first").alias("_firsts"),
        F.count(F.lit(1)).alias("_present"),
        F.sum("true_share").alias("_t"),
        F.sum(F.col("true_share") * F.col("true_share")).alias("_tt"),
        F.sum(err).alias("_e"),
        F.sum(err * err).alias("_ee"),
        F.sum(F.abs(err)).alias("_ae"),
        F.min("true_share").alias("_low"),
        F.max("true_share").alias("_high"),
    )
    sums = sums.withColumn("_n", F.sum("_firsts").over(Window.partitionBy(F.lit(0))))
    n = F.col("_n")
    low = F.when(F.col("_present") < n, F.lit(0.0)).otherwise(F.col("_low"))
    spread = F.col("_tt") - F.col("_t") * F.col("_t") / n
    r2 = F.when(low == F.col("_high"), F.lit(float("nan"))).otherwise(
        F.lit(1.0) - F.try_divide(F.col("_ee"), spread)
    )
    out = sums.select(
        "class_id",
        (F.col("_t") / n * 100).alias("mean_true_cover_pct"),
        (F.col("_e") / n * 100).alias("bias_pct"),
        (F.sqrt(F.col("_ee") / n) * 100).alias("rmse_pct"),
        (F.col("_ae") / n * 100).alias("mae_pct"),
        r2.alias("r_squared"),
    )
    if classes is not None:
        out = out.join(classes.select("class_id", "class_name"), "class_id")
        out = out.select("class_id", "class_name", *out.columns[1:-1])
    return out.orderBy(F.desc("mean_true_cover_pct"), "class_id")


def significant(cover: DataFrame) -> DataFrame:
    return cover.where(F.col("mean_true_cover_pct") > SIGNIFICANT_PCT)


def cover_scalars(cover: DataFrame) -> DataFrame:
    """One row over the significant classes; zeros when there is none."""
    known = F.when(~F.isnan("r_squared"), F.col("r_squared"))
    none = F.count(F.lit(1)) == 0
    return significant(cover).agg(
        F.coalesce(F.avg(F.abs("bias_pct")), F.lit(0.0)).alias("cover_mean_abs_bias_pct"),
        F.coalesce(F.avg("rmse_pct"), F.lit(0.0)).alias("cover_mean_rmse_pct"),
        F.coalesce(F.avg("mae_pct"), F.lit(0.0)).alias("cover_mean_mae_pct"),
        F.when(none, F.lit(0.0))
        .otherwise(F.coalesce(F.median(known), F.lit(float("nan"))))
        .alias("cover_median_r_squared"),
    )


def bias_view(cover: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most covered significant classes with their bias."""
    return (
        significant(cover)
        .orderBy(F.desc("mean_true_cover_pct"), "class_id")
        .limit(n)
        .select("class_id", "mean_true_cover_pct", "bias_pct")
    )
