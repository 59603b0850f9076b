"""Per-source annotation and image-list CSV files below one root.

Layout: ``<root>/s<id>/annotations.csv`` and ``<root>/s<id>/image_list.csv``, or folders named
``source_id=<id>`` as Spark writes them. Headers differ from source to source, so the files are
grouped by header and each layout is one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.text import image_of_page, strip_status
from quadrat.operators.staging import stage
from quadrat.sources.specs import file_order, last_per_key

# Headers of the per-source files.
BASIC_COLUMNS = ("Row", "Column", "Label ID")
IMAGE_ID = "Image ID"
NAME = "Name"
PAGE = "Image Page"

# Bytes read at a time on the way to the end of a file's first line.
HEAD_BYTES = 1 << 14

# Schemes whose paths begin with a bucket.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs")

_SOURCE_OF_FILE = r"/(?:s|source_id=)([^/=]+)/[^/]+$"
_LINE = "_line"


def source_of_file() -> Column:
    return F.regexp_extract("_metadata.file_path", _SOURCE_OF_FILE, 1)


def first_line(stream: BinaryIO) -> str | None:
    """The first line of a UTF-8 text, read in pieces up to its end; None for an empty text.

    A line ends with ``\\n``, ``\\r\\n`` or ``\\r``; a byte order mark is not part of it.
    """
    held = b""
    while piece := stream.read(HEAD_BYTES):
        held += piece
        ends = [at for at in (held.find(b"\n"), held.find(b"\r")) if at >= 0]
        if ends:
            held = held[: min(ends)]
            break
    else:
        if not held:
            return None
    return held.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


def place(path: str) -> str:
    """A file's path as its pyarrow file system has it: with the bucket for object stores, else from the root."""
    scheme, colon, rest = path.partition(":")
    bucket, _, inner = rest.removeprefix("//").partition("/")
    return f"{bucket}/{inner}" if scheme in OBJECT_STORES else "/" + (inner if rest.startswith("//") else rest.lstrip("/"))


def read_first_lines(spark: SparkSession, glob: str, files: fs.FileSystem | None = None) -> DataFrame:
    """(file, source_id, header) of every file that matches, its first line; empty files have none.

    Of the scan only paths are wanted, so no content is read there; each task then opens its files in ``files`` and reads up to the
    first line's end (compressed files are told by their name). A path on the local file system needs no ``files``. Without it, files elsewhere can be
    opened by Spark alone, which reads them whole.
    """
    listed = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file"), source_of_file().alias("source_id"))
    if files is None:
        some = listed.select("file").first()
        if some is None or not some["file"].startswith("file:"):
            return scan_first_lines(spark, glob)
        files = fs.LocalFileSystem()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for path in batch.column("file").to_pylist():
                with files.open_input_stream(place(path), buffer_size=HEAD_BYTES) as stream:
                    lines.append(first_line(stream))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.string())], ["file", "source_id", "header"])

    heads = listed.mapInArrow(read, "file string, source_id string, header string")
    return heads.where(F.col("header").isNotNull())


def scan_first_lines(spark: SparkSession, glob: str) -> DataFrame:
    """As ``read_first_lines``, by a scan of all lines."""
    lines = spark.read.text(glob).select(
        F.col("_metadata.file_path").alias("file"),
        source_of_file().alias("source_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias(_LINE),
        "value",
    )
    # Splits are cut at line ends: one line of each file stays in the task that reads the file's start.
    start = lines.where(F.col("block") == 0)
    return start.groupBy("file", "source_id").agg(F.min_by("value", _LINE).alias("header"))


def read_headers(spark: SparkSession, glob: str, files: fs.FileSystem | None = None) -> DataFrame:
    """(file, source_id, columns) of every CSV file that matches; quoted names are read as CSV has them."""
    first = stage(read_first_lines(spark, glob, files), "headers")
    widest = first.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    cells = F.from_csv("header", F.lit(", ".join(f"c{i} string" for i in range(widest))))
    named = F.array_compact(F.array(*[F.col(f"cells.c{i}") for i in range(widest)]))
    return first.withColumn("cells", cells).select("file", "source_id", named.alias("columns"))


def with_usability(headers: DataFrame) -> DataFrame:
    """Why a source cannot be used: NULL, ``missing_columns`` or ``no_image_column``."""
    has_all = F.forall(
        F.array(*[F.lit(c) for c in BASIC_COLUMNS]), lambda c: F.array_contains(F.col("columns"), c)
    )
    named = F.array_contains("columns", F.lit(IMAGE_ID)) | F.array_contains("columns", F.lit(NAME))
    reason = F.when(~has_all, "missing_columns").when(~named, "no_image_column")
    return headers.withColumn("reason", reason)


def read_source_annotations(
    spark: SparkSession, glob: str, files: fs.FileSystem | None = None
) -> tuple[DataFrame, DataFrame]:
    """All usable annotation rows (``<root>/s*/annotations.csv``), and the skipped sources with why.

    ``files`` opens the headers in tasks, see ``read_first_lines``.
    """
    headers = with_usability(read_headers(spark, glob, files))
    skipped = headers.where(F.col("reason").isNotNull()).select("source_id", "reason")
    # File names of each layout: as many as the scans below list anyway.
    layouts: dict[tuple[str, ...], list[str]] = {}
    usable = headers.where(F.col("reason").isNull()).select("columns", "file")
    for header in usable.toLocalIterator():
        layouts.setdefault(tuple(header["columns"]), []).append(header["file"])
    rows = None
    for files in layouts.values():
        scan = spark.read.csv(sorted(files), header=True).withColumn("source_id", source_of_file())
        rows = scan if rows is None else rows.unionByName(scan, allowMissingColumns=True)
    if rows is None:
        rows = spark.createDataFrame([], "source_id string, Row string, Column string, `Label ID` string")
    for name in (IMAGE_ID, NAME):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows, skipped


def read_image_lists(spark: SparkSession, glob: str) -> DataFrame:
    """(source_id, name_norm, image_id) of ``<root>/s*/image_list.csv``, the last row of a name winning."""
    df = spark.read.csv(glob, header=True)
    missing = [c for c in (NAME, PAGE) if c not in df.columns]
    if missing:
        raise ValueError(f"{glob}: an image list needs the columns {missing}")
    return name_map(df.withColumn("source_id", source_of_file()), file_order())


def name_map(images: DataFrame, order: Column | None = None) -> DataFrame:
    """(source_id, name_norm, image_id); ``order`` says which row of a name is the last (rows as they come by default)."""
    listed = images.where(F.col(NAME).isNotNull()).select(
        "source_id",
        strip_status(F.col(NAME)).alias("name_norm"),
        image_of_page(F.col(f"`{PAGE}`")).alias("image_id"),
        (F.monotonically_increasing_id() if order is None else order).alias(_LINE),
    )
    listed = listed.where(F.col("image_id").isNotNull())
    return last_per_key(listed, ("source_id", "name_norm"), _LINE)


def resolve_images(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``image_id``: the row's own image id column, otherwise looked up by normalised name.

    Only rows that need the lookup, and have a name, are joined; the others stay where they are read.
    """
    own = F.col(f"`{IMAGE_ID}`") if IMAGE_ID in rows.columns else F.lit(None).cast("string")
    marked = rows.withColumn("image_id", own).withColumn("_name", strip_status(F.col(NAME)))
    lookup = F.col("image_id").isNull() & F.col("_name").isNotNull()
    named = names.select(
        F.col("source_id").alias("_source"), F.col("name_norm").alias("_norm"), F.col("image_id").alias("_mapped")
    )
    looked_up = marked.where(lookup).join(
        named, (F.col("source_id") == F.col("_source")) & (F.col("_name") == F.col("_norm")), "left"
    )
    columns = [f"`{c}`" for c in rows.columns]
    return marked.where(~lookup).select(*columns, "image_id").unionByName(
        looked_up.select(*columns, F.col("_mapped").alias("image_id"))
    )


def mapped_rows(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("image_id").isNotNull())


def unmapped_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("image_id").isNull()).alias("unmapped")
    )


def split_available(wanted: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources whose annotation file is listed, and those without one."""
    return (
        wanted.join(listing, "source_id", "left_semi"),
        wanted.join(listing, "source_id", "left_anti"),
    )


def first_missing(missing: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` missing sources that a report names."""
    return missing.orderBy("source_id").limit(n)
