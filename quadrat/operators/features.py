"""Feature availability, points by image, extraction work lists and feature drift."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import keys
from quadrat.functions.numbers import cosine, max_abs_difference
from quadrat.operators.folding import fold_groups
from quadrat.operators.prepare import PHYSICAL_KEY
from quadrat.operators.ranking import exact_percentile
from quadrat.operators.staging import new_folder, own_table, stage

logger = logging.getLogger(__name__)

class MissingFeatures(RuntimeError):
    """More feature vectors are missing than allowed."""


def with_full_path(df: DataFrame) -> DataFrame:
    return df.withColumn("feature_full", keys.full_path())


def missing_features(paths: DataFrame, listing: DataFrame, path: str = "feature_full") -> DataFrame:
    """Distinct paths that the listing does not have."""
    return paths.select(path).distinct().join(listing.select(path), path, "left_anti")


def present_rows(df: DataFrame, listing: DataFrame, path: str = "feature_full") -> DataFrame:
    return df.join(listing.select(path), path, "left_semi").select(*df.columns)


def missing_counts(df: DataFrame, listing: DataFrame, path: str = "feature_full") -> DataFrame:
    """One row: distinct paths, and how many of them are missing."""
    have = listing.select(path).distinct().withColumn("_have", F.lit(True))
    return (
        df.select(path)
        .distinct()
        .join(have, path, "left")
        .agg(F.count(path).alias("expected"), F.count_if(F.col("_have").isNull()).alias("missing"))
    )


def example_paths(missing: DataFrame, path: str = "feature_full", n: int = 3) -> DataFrame:
    """The first ``n`` missing paths in path order."""
    return missing.orderBy(path).limit(n)


def require_features(
    df: DataFrame, listing: DataFrame, percent_allowed: float = 0.0, path: str = "feature_full"
) -> DataFrame:
    """Rows whose feature file exists; beyond ``percent_allowed`` missing files the build stops and names some.

    The distinct paths are written once and the listing runs past them, so it is not sorted; the paths found
    give the counts, the examples and the rows to keep.
    """
    wanted = stage(df.select(path).distinct(), "features")
    found = stage(listing.select(path).join(wanted.hint("shuffle_hash"), path, "left_semi").distinct(), "features")
    counts = wanted.agg(F.count(path).alias("expected"), F.count(F.lit(1)).alias("paths")).first()
    missing = counts["paths"] - found.count()
    if missing:
        examples = [r[0] for r in example_paths(missing_features(wanted, found, path), path).collect()]
        if missing > counts["expected"] * percent_allowed / 100:
            raise MissingFeatures(f"{missing} of {counts['expected']} feature files do not exist, among them {examples}")
        logger.warning("Leaving out %d points' feature files that do not exist, among them %s", missing, examples)
    return present_rows(df, found, path)


def image_points(df: DataFrame) -> DataFrame:
    """Points by image: one row per point with its image (bucket, feature path), place and class, sorted within an image.

    The table is range-partitioned by image and place, so an image of any size may span tasks, and files.
    """
    return df.select(
        "bucket", "feature_vector", "row", "col", keys.class_key("attribute_id", "form_id").alias("class_key")
    ).orderBy("bucket", "feature_vector", "row", "col", "class_key")


def image_counts(df: DataFrame) -> DataFrame:
    """Per image (bucket, feature path): how many points it has."""
    return df.groupBy("bucket", "feature_vector").agg(F.count(F.lit(1)).alias("points"))


def point_walks(df: DataFrame, by: Sequence[str] = ("bucket", "feature_vector")) -> DataFrame:
    """Per image, or other group, the way over its points by row and column: points, first and last place, and the length in steps along both axes.

    Points are folded as a stream in their order, so an image of any size may span tasks. Points without row or column are left out.
    """

    def of_run(batch: pa.RecordBatch) -> tuple:
        row, col = (batch.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        length = int(np.abs(np.diff(row)).sum() + np.abs(np.diff(col)).sum())
        return len(row), int(row[0]), int(col[0]), int(row[-1]), int(col[-1]), length

    def join(a: tuple, b: tuple) -> tuple:
        gap = abs(b[1] - a[3]) + abs(b[2] - a[4])
        return a[0] + b[0], a[1], a[2], b[3], b[4], a[5] + b[5] + gap

    placed = df.where(F.col("row").isNotNull() & F.col("col").isNotNull()).select(*by, "row", "col")
    state = "points long, first_row long, first_col long, last_row long, last_col long, length long"
    return fold_groups(placed, by, ["row", "col"], of_run, join, state)


def _unfinished(rows: DataFrame, existing: DataFrame | None, force: bool) -> DataFrame:
    todo = rows.select("source_id", "image_id", "row", "col")
    if existing is None or force:
        return todo
    return todo.join(existing, ["source_id", "image_id"], "left_anti")


def extraction_points(rows: DataFrame, existing: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Distinct points of the images still to be extracted, one row per point, sorted by image."""
    return _unfinished(rows, existing, force).distinct().orderBy("source_id", "image_id", "row", "col")


def extraction_work(
    rows: DataFrame,
    existing: DataFrame | None = None,
    source_prefix: str = "",
    force: bool = False,
) -> DataFrame:
    """Images still to be extracted, one row each: number of distinct points, image path and feature path.

    ``existing(source_id, image_id)`` lists finished images; ``force`` ignores it.
    """
    images = (
        _unfinished(rows, existing, force)
        .distinct()
        .groupBy("source_id", "image_id")
        .agg(F.count(F.lit(1)).alias("points"))
    )
    image = F.concat(
        F.lit(f"{source_prefix}s"), F.col("source_id"), F.lit("/images/"), F.col("image_id"), F.lit(".jpg")
    )
    return images.select(
        "source_id",
        "image_id",
        "points",
        image.alias("image_path"),
        keys.provider_feature_path(F.col("source_id"), F.col("image_id")).alias("feature_path"),
    )


def require_one_vector(features: DataFrame) -> None:
    """Raise if a point has more than one feature vector. Only keys are read, and a table of ``store_features`` is not shuffled."""
    twice = features.groupBy(*PHYSICAL_KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).limit(3).collect()
    if twice:
        raise ValueError(f"More than one feature vector for {[tuple(r)[:-1] for r in twice]}.")


def store_features(features: DataFrame, buckets: int | None = None) -> DataFrame:
    """Write feature vectors once, in files by point key, for any number of later ``join_features``.

    The table is bucketed and sorted by (bucket, feature path, row, col), one file for each bucket, so a join moves the points alone: a vector
    is some kilobytes, a point some dozen bytes. By default there are as many buckets as shuffle partitions; with fewer, the join would shuffle the vectors. Points of
    a large image are spread over the buckets. A point with two vectors is an error.
    """
    spark = features.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"features_{uuid.uuid4().hex}"
    writer = features.repartition(buckets, *PHYSICAL_KEY).write.format("parquet").bucketBy(buckets, *PHYSICAL_KEY).sortBy(*PHYSICAL_KEY)
    writer.option("path", new_folder(spark, "features")).saveAsTable(name)
    own_table(spark, name)
    stored = spark.table(name)
    require_one_vector(stored)
    return stored


def join_features(points: DataFrame, features: DataFrame) -> DataFrame:
    """Labelled points with their feature vector, by (bucket, feature path, row, col); points without one drop.

    ``features`` must have one vector for each key (``require_one_vector``), so a point is kept once. From a table of ``store_features`` no vector moves.
    """
    return points.join(features, PHYSICAL_KEY)


def drift_rows(a: DataFrame, b: DataFrame, key: Sequence[str], column: str = "features") -> DataFrame:
    """Cosine similarity and largest absolute difference of two versions of each vector."""
    left = a.select(*key, F.col(column).alias("_a"))
    right = b.select(*key, F.col(column).alias("_b"))
    return left.join(right, list(key)).select(
        *key,
        cosine(F.col("_a"), F.col("_b")).alias("cosine"),
        max_abs_difference(F.col("_a"), F.col("_b")).alias("max_abs_diff"),
    )


def drift_summary(drift: DataFrame, threshold: float = 0.999) -> DataFrame:
    """One row: smallest and median cosine, largest difference, and the verdict."""
    one = drift.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("cosine").alias("min_cosine"),
        F.max("max_abs_diff").alias("max_abs_diff"),
    ).first()
    median = exact_percentile(drift, "cosine", 0.5)
    ok = one["min_cosine"] is not None and one["min_cosine"] >= threshold
    return drift.sparkSession.createDataFrame(
        [(one["n"], one["min_cosine"], median, one["max_abs_diff"], ok)],
        "n bigint, min_cosine double, median_cosine double, max_abs_diff double, passed boolean",
    )


def require_no_drift(drift: DataFrame, threshold: float = 0.999) -> DataFrame:
    summary = drift_summary(drift, threshold)
    one = summary.first()
    if not one["passed"]:
        raise RuntimeError(
            f"Feature check failed: min cosine similarity {one['min_cosine']} < {threshold}."
        )
    return summary
