"""Readers with a fixed column contract: manifests, native annotations, raw tables, listings, features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import keys

# Column contracts of the input tables. ``label_id`` is the provider's label number;
# files that call it otherwise are read with ``columns={"label_id": "their name"}``.
MANIFEST_INPUT = ("source_id", "image_id", "row", "col", "label_id")
NATIVE_INPUT = ("image_id", "row", "col", "attribute_id", "form_id")
RAW_ANNOTATIONS = "source_id int, image_id string, row int, col int, label_id int, status string"
RAW_IMAGES = (
    "source_id int, image_id string, s3_key string, width int, height int, longest_edge int, "
    "file_size bigint, needs_resize boolean, header_status string, error_message string"
)
AUDIT_INPUT = ("source_id", "is_complete", "image_count_match")


def read_columns(
    spark: SparkSession,
    path: str,
    wanted: Sequence[str],
    columns: Mapping[str, str] | None = None,
    what: str = "table",
) -> DataFrame:
    """Parquet columns under contract names; failures name the path and the columns needed."""
    names = {c: (columns or {}).get(c, c) for c in wanted}
    try:
        df = spark.read.parquet(path)
        absent = [n for n in names.values() if n not in df.columns]
        reason = f"it has no {', '.join(absent)}" if absent else None
    except AnalysisException as error:
        df, reason = None, error.getMessage() or str(error)
    if reason:
        raise RuntimeError(f"No usable {what} at {path} (columns wanted: {', '.join(names.values())}): {reason}")
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def to_provider_points(df: DataFrame, site: str = "provider", bucket: str = "features") -> DataFrame:
    """Manifest columns in the annotation layout; rows without an image id are left out."""
    return df.where(F.col("image_id").isNotNull() & (F.col("image_id").cast("string") != "")).select(
        "row",
        "col",
        F.col("image_id").cast("string").alias("image_id"),
        F.col("label_id").cast("string").alias("label_id"),
        F.lit(site).alias("site"),
        F.lit(bucket).alias("bucket"),
        F.col("source_id").cast("string").alias("project_id"),
        keys.provider_feature_path(F.col("source_id"), F.col("image_id")).alias("feature_vector"),
    )


def to_native_points(
    df: DataFrame, site: str = "native", bucket: str = "native-features", prefix: str = "native"
) -> DataFrame:
    """Native-site annotations in the annotation layout; they carry their class already."""
    return df.select(
        "image_id",
        "row",
        "col",
        "attribute_id",
        "form_id",
        F.lit(site).alias("site"),
        F.lit(bucket).alias("bucket"),
        F.lit("all").alias("project_id"),
        keys.native_feature_path(prefix, F.col("image_id")).alias("feature_vector"),
    )


def read_manifest(
    spark: SparkSession,
    path: str,
    site: str = "provider",
    bucket: str = "features",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    return to_provider_points(
        read_columns(spark, path, MANIFEST_INPUT, columns, "manifest"), site, bucket
    )


def read_native(
    spark: SparkSession,
    path: str,
    site: str = "native",
    bucket: str = "native-features",
    prefix: str = "native",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    return to_native_points(
        read_columns(spark, path, NATIVE_INPUT, columns, "annotations"), site, bucket, prefix
    )


def read_raw(
    spark: SparkSession,
    annotations_path: str,
    images_path: str,
    columns: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Raw annotation and image tables; only columns that the manifest uses reach the scan."""
    annotations = read_columns(
        spark, annotations_path, MANIFEST_INPUT, columns, "annotations"
    )
    images = read_columns(
        spark,
        images_path,
        ("source_id", "image_id", "s3_key", "width", "height", "header_status"),
        None,
        "images",
    )
    return annotations, images


def flagged_sources(audit: DataFrame) -> DataFrame:
    """Sources that the audit calls incomplete or with a wrong image count (report only)."""
    return audit.where(~F.col("is_complete") | ~F.col("image_count_match")).select("source_id")


def list_feature_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths of the files present below ``path``; the contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .select(F.regexp_replace("path", r"^[a-z0-9]+:/+", "").alias("feature_full"))
    )


def all_listings(*listings: DataFrame) -> DataFrame:
    """The distinct paths of several listings, one per site."""
    return reduce(DataFrame.union, [x.select("feature_full") for x in listings]).distinct()


def existing_images(listing: DataFrame, path: str = "feature_full") -> DataFrame:
    """(source_id, image_id) of the feature files in a listing."""
    source = F.nullif(F.regexp_extract(path, r"(?:^|/)s([^/]+)/features/i[^/]+\.featurevector$", 1), F.lit(""))
    return (
        listing.select(source.alias("source_id"), keys.image_of_feature_path(path).alias("image_id"))
        .where(F.col("image_id").isNotNull())
        .distinct()
    )


def flatten_features(records: DataFrame, points: str = "point_features") -> DataFrame:
    """One row per point of per-image records ``points: array<struct<row,col,data>>``."""
    rest = [c for c in records.columns if c != points]
    flat = records.select(*rest, F.explode(points).alias("_p"))
    return flat.select(
        *rest, F.col("_p.row").alias("row"), F.col("_p.col").alias("col"), F.col("_p.data").alias("features")
    )


def check_one_dimension(features: DataFrame, column: str = "features") -> int:
    """The common vector length; different lengths in one table are an error."""
    low, high = features.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"Feature vectors differ in length: {low} to {high}.")
    return low
