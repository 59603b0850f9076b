"""CSV specification files: blanks stay ``''``, columns are resolved by name, bad rows are named."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.text import normal_id

LINE = "_line"

# Header names of the specification files.
SOURCE_ID_COLUMNS = ("id", "Source ID", "source_id")


@dataclass(frozen=True)
class SpecColumn:
    """A required column: one name or several accepted ones, the first present being used."""

    name: str | tuple[str, ...]
    allow_blank: bool = True
    alias: str | None = None

    @property
    def candidates(self) -> tuple[str, ...]:
        return (self.name,) if isinstance(self.name, str) else self.name

    @property
    def output(self) -> str:
        return self.alias or self.candidates[0]


FILTER_COLUMNS = (
    SpecColumn("ba_id", allow_blank=False, alias="attribute_id"),
    SpecColumn("gf_id", alias="form_id"),
)
ROLLUP_COLUMNS = (
    SpecColumn("from_ba_id", allow_blank=False, alias="from_attribute_id"),
    SpecColumn("from_gf_id", alias="from_form_id"),
    SpecColumn("to_ba_id", allow_blank=False, alias="to_attribute_id"),
    SpecColumn("to_gf_id", alias="to_form_id"),
)
SOURCE_COLUMNS = (SpecColumn("id", allow_blank=False),)


def file_order(position: Column | None = None) -> Column:
    """Order of a row in its input: file name, place of the split in the file, line in the split, position in the line.

    Files are packed into tasks by size, so the running row id alone does not follow their names.
    """
    parts = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    ]
    return F.struct(*parts, *([] if position is None else [position.alias("position")]))


def read_text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-string CSV with a header, blank cells as ``''``. Files of a folder count in the order of their names."""
    return _text_csv(spark, path).drop(LINE)


def _text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=False)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns], file_order().alias(LINE))


def empty_spec(spark: SparkSession, columns: Sequence[SpecColumn]) -> DataFrame:
    schema = ", ".join(f"`{c.output}` string" for c in columns)
    return spark.createDataFrame([], f"{schema}, {LINE} struct<file:string,block:bigint,line:bigint>")


def resolve(df: DataFrame, columns: Sequence[SpecColumn], path: str) -> DataFrame:
    """Project to the declared columns, plus the file line order."""
    picked = []
    for column in columns:
        present = [c for c in column.candidates if c in df.columns]
        if not present:
            if len(column.candidates) == 1:
                raise ValueError(f"{path}: the column {column.candidates[0]} is missing")
            raise ValueError(f"{path}: of the columns {', '.join(column.candidates)} not one is there")
        picked.append((column, present[0]))
    out = df.select(
        *[F.col(f"`{name}`").alias(column.output) for column, name in picked],
        LINE,
    )
    for column, name in picked:
        if column.allow_blank:
            continue
        bad = out.where(F.col(column.output) == "").agg(F.min(LINE)).first()[0]
        if bad is not None:
            place = F.struct(*[F.lit(v).alias(k) for k, v in bad.asDict().items()])
            row = out.where(F.col(LINE) <= place).count()
            raise ValueError(f"{path}: {name} is blank in row {row}")
    return out


def load_spec(spark: SparkSession, path: str, columns: Sequence[SpecColumn]) -> DataFrame:
    df = _text_csv(spark, path)
    if df.columns == [LINE]:
        return empty_spec(spark, columns)
    return resolve(df, columns, path)


def load_filter(spark: SparkSession, path: str) -> DataFrame:
    return load_spec(spark, path, FILTER_COLUMNS).drop(LINE).distinct()


def load_rollup(spark: SparkSession, path: str) -> DataFrame:
    return last_per_key(
        load_spec(spark, path, ROLLUP_COLUMNS), ("from_attribute_id", "from_form_id")
    )


def last_per_key(df: DataFrame, by: Sequence[str], order: str = LINE) -> DataFrame:
    """One row per key, the last in file order winning."""
    rest = [c for c in df.columns if c not in by and c != order]
    kept = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return kept.select(*by, *[F.col(f"_last.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, by: Sequence[str], order: str = LINE) -> DataFrame:
    """One row per key, the first in file order, with that order kept for sorting."""
    rest = [c for c in df.columns if c not in by and c != order]
    picked = [F.min(order).alias(order)]
    if rest:
        picked.append(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    kept = df.groupBy(*by).agg(*picked)
    return kept.select(*by, *[F.col(f"_first.{c}").alias(c) for c in rest], order)


def id_column(
    columns: Sequence[str], override: str | None = None, candidates: Sequence[str] = SOURCE_ID_COLUMNS
) -> str:
    if override:
        if override not in columns:
            raise ValueError(f"The list has no column {override!r} to take source ids from, only {list(columns)}")
        return override
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"No column of {list(columns)} is known to hold source ids ({', '.join(candidates)}).")


def source_ids(raw: DataFrame, column: str | None = None) -> DataFrame:
    """Normalised, non-blank ids of a source list, first occurrence of each, in file order."""
    name = id_column([c for c in raw.columns if c != LINE], column)
    line = F.col(LINE) if LINE in raw.columns else F.monotonically_increasing_id()
    listed = raw.select(normal_id(F.col(f"`{name}`")).alias("source_id"), line.alias(LINE)).where(F.col("source_id").isNotNull())
    return first_per_key(listed, ["source_id"]).orderBy(LINE).select("source_id", LINE)


def load_source_ids(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    return source_ids(_text_csv(spark, path), column)


def load_items(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Non-blank cells of one column (the first by default) with their file order."""
    df = _text_csv(spark, path)
    names = [c for c in df.columns if c != LINE]
    name = column or names[0]
    if name not in names:
        raise ValueError(f"{path} has no column {name!r}, only {names}")
    return df.select(F.col(f"`{name}`").alias("item"), LINE).where(F.col("item") != "")
