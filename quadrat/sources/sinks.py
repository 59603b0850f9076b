"""Parquet, CSV and JSON-lines sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadrat.operators.staging import remove_folder

# Header names of the written specification files.
ROLLUP_HEADER = ("from_ba_id", "from_gf_id", "to_ba_id", "to_gf_id")
INCLUDED_HEADER = ("ba_id", "gf_id")

EMPTY_MANIFEST = "Refusing to write an empty manifest: no point passed the filters."

# Write modes that fail where the path is there, so that what is there afterwards was written by the call.
NEW_ONLY = ("errorifexists", "error", "default")


def write_manifest(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a manifest; an empty one is refused and leaves nothing behind.

    A new manifest is counted while it is written, so what makes it runs once. Where one may be there already, rows are looked for first.
    """
    if mode not in NEW_ONLY:
        if manifest.isEmpty():
            raise ValueError(EMPTY_MANIFEST)
        manifest.write.mode(mode).parquet(path)
        return
    seen = Observation()
    manifest.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    if not seen.get.get("rows"):
        remove_folder(manifest.sparkSession, path)
        raise ValueError(EMPTY_MANIFEST)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    # An empty string is written as nothing so that a reader gets a blank cell, not quotes.
    df.write.mode(mode).csv(path, header=True, emptyValue="")


def write_rollups(rows: DataFrame, path: str) -> None:
    out = rows.select(
        *[
            F.col(c).alias(h)
            for c, h in zip(
                ("from_attribute_id", "from_form_id", "to_attribute_id", "to_form_id"), ROLLUP_HEADER
            )
        ]
    )
    write_csv(out.orderBy(*ROLLUP_HEADER), path)


def write_included(rows: DataFrame, path: str) -> None:
    out = rows.select(
        F.col("attribute_id").alias("ba_id"), F.col("form_id").alias("gf_id")
    )
    write_csv(out.orderBy(*INCLUDED_HEADER), path)


def write_sources(ids: DataFrame, path: str, order: str | None = None) -> None:
    out = ids.orderBy(order) if order else ids
    write_csv(out.select(F.col("source_id").alias("id")), path)


def wide_predictions(
    points: DataFrame, ranked: DataFrame, n: int, order: str, key: Sequence[str] = ("row", "column")
) -> DataFrame:
    """Input rows with the ``n`` best labels of their point as label, score, label2, score2, ...

    ``points`` keeps its other columns and its order (``order``); ``ranked(key..., rank, label,
    score)`` is the long prediction table. Scores are text with four decimals.
    """
    best = ranked.where(F.col("rank") <= n).groupBy(*key).agg(
        *[
            agg
            for i in range(1, n + 1)
            for agg in (
                F.max(F.when(F.col("rank") == i, F.col("label"))).alias(_name("label", i)),
                F.max(
                    F.when(F.col("rank") == i, F.format_string("%.4f", F.col("score")))
                ).alias(_name("score", i)),
            )
        ]
    )
    made = [name for i in range(1, n + 1) for name in (_name("label", i), _name("score", i))]
    rest = [c for c in points.columns if c not in made and c not in key and c != order]
    left = points.select(*key, *rest, order)
    return left.join(best, list(key), "left").orderBy(order).select(*key, *made, *rest)


def _name(stem: str, i: int) -> str:
    return stem if i == 1 else f"{stem}{i}"


def write_annotations_by_source(df: DataFrame, path: str, source: str = "source_id", image: str = "Image ID") -> None:
    """Annotations in one folder per source, appended for the sources that have none there yet.

    Rows that carry a resolved ``image_id`` are written with it as the column ``image``, in place of their own. A source that is
    there is left as it is, whatever its rows. The rows are made once, by the write; which sources are there is listed before it.
    """
    if "image_id" in df.columns:
        df = df.drop(image).withColumnRenamed("image_id", image)
    spark = df.sparkSession
    rows = df
    try:
        # Of a binary file only its path is wanted, so no content is read.
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        present = files.select(F.regexp_extract("path", rf"/{source}=([^/]*)/", 1).alias("_there"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        rows = rows.join(present.distinct(), F.col(source).cast("string") == F.col("_there"), "left_anti")
    rows.write.mode("append").partitionBy(source).csv(path, header=True, emptyValue="")


def append_work_log(log: DataFrame, path: str) -> None:
    """Append log rows as JSON lines, stamped when they carry no time."""
    if "ts" not in log.columns:
        log = log.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    log.write.mode("append").json(path)


def append_failures(log: DataFrame, path: str) -> None:
    failures = log.where(F.col("outcome") == "failed")
    failures.select("ts", "source_id", "image_id", "error_type", "error_msg").write.mode(
        "append"
    ).csv(path, header=True)
