"""Manifest build: annotations joined with valid images, and its summary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFEST_COLUMNS = (
    "source_id",
    "image_id",
    "row",
    "col",
    "label_id",
    "source_label_name",
    "image_s3_key",
    "load_width",
    "load_height",
    "uses_resized_image",
)


def integer_ids(source_ids: Iterable[str] | None) -> list[int]:
    try:
        return [int(s) for s in source_ids or []]
    except ValueError as exc:
        raise ValueError(f"source ids must be integers; got: {list(source_ids)}") from exc


def only_sources(df: DataFrame, source_ids: Iterable[str] | DataFrame | None) -> DataFrame:
    """Rows of the named sources: a pushed-down IN list, or a semi join with an id table."""
    if source_ids is None:
        return df
    if isinstance(source_ids, DataFrame):
        return df.join(source_ids, "source_id", "left_semi")
    ids = integer_ids(source_ids)
    return df.where(F.col("source_id").isin(ids)) if ids else df


def valid_image() -> Column:
    return (F.col("header_status") == "ok") & F.col("s3_key").isNotNull()


def build_manifest(
    annotations: DataFrame,
    images: DataFrame,
    source_ids: Iterable[str] | DataFrame | None = None,
) -> DataFrame:
    """One row per annotated point of a valid image, in the manifest's column order."""
    points = only_sources(annotations, source_ids)
    valid = images.where(valid_image()).select(
        "source_id",
        "image_id",
        F.col("s3_key").alias("image_s3_key"),
        F.col("width").alias("load_width"),
        F.col("height").alias("load_height"),
    )
    return points.join(valid, ["source_id", "image_id"]).select(
        "source_id",
        "image_id",
        "row",
        "col",
        "label_id",
        F.lit(None).cast("string").alias("source_label_name"),
        "image_s3_key",
        "load_width",
        "load_height",
        F.lit(False).alias("uses_resized_image"),
    )


def summarize_build(
    annotations: DataFrame,
    images: DataFrame,
    source_ids: Iterable[str] | DataFrame | None = None,
) -> DataFrame:
    """One row: points_in, points_kept, points_dropped_invalid_image, sources_out."""
    seen = only_sources(annotations, source_ids).select(
        F.lit(False).alias("kept"), F.lit(None).cast("string").alias("source")
    )
    kept = build_manifest(annotations, images, source_ids).select(
        F.lit(True).alias("kept"), F.col("source_id").cast("string").alias("source")
    )
    # Per-source partial counts first, so the distinct count sees one row per source.
    per_source = seen.union(kept).groupBy("kept", "source").agg(F.count(F.lit(1)).alias("n"))
    totals = per_source.agg(
        F.coalesce(F.sum(F.when(~F.col("kept"), F.col("n"))), F.lit(0)).alias("points_in"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).alias("points_kept"),
        F.count_if(F.col("kept") & F.col("source").isNotNull()).alias("sources_out"),
    )
    return totals.select(
        "points_in",
        "points_kept",
        (F.col("points_in") - F.col("points_kept")).alias("points_dropped_invalid_image"),
        "sources_out",
    )
