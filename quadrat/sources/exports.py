"""JSON exports of the taxonomy, the form list and the label mapping, and label name files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.sources.specs import file_order, read_text_csv

NODE = "struct<id:string,name:string,parent:string>"
MAPPING = (
    "struct<provider_id:string,provider_label:string,benthic_attribute_id:string,"
    "benthic_attribute_name:string,growth_form_id:string,growth_form_name:string>"
)


def read_taxonomy(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nodes (id, name, parent) of export files with a ``results`` array; a root has no parent.

    ``multi_line`` reads one document per file, otherwise one per line.
    """
    df = spark.read.schema(f"results array<{NODE}>").json(path, multiLine=multi_line)
    return df.select(F.explode("results").alias("r")).select("r.*")


def read_forms(
    spark: SparkSession, path: str, list_name: str = "growthforms", multi_line: bool = True
) -> DataFrame:
    """Forms (id, name) from the named entry of a choices export."""
    schema = "name string, data array<struct<id:string,name:string>>"
    lists = spark.read.schema(schema).json(path, multiLine=multi_line)
    entries = lists.where(F.col("name") == list_name)
    if entries.isEmpty():
        raise ValueError(f"The export at {path} has no list {list_name!r}.")
    return entries.select(F.explode("data").alias("d")).select("d.*")


def read_label_mapping(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Provider label to class; a missing form reads as ``''``. One row per label.

    Of several entries the last wins, in the order of the pages' file names and of the entries within a page.
    """
    df = spark.read.schema(f"results array<{MAPPING}>").json(path, multiLine=multi_line)
    pages = df.select(file_order().alias("_page"), F.posexplode("results").alias("_at", "r"))
    rows = pages.select("r", F.struct("_page", "_at").alias("_line"))
    rows = rows.groupBy("r.provider_id").agg(F.max_by("r", "_line").alias("r"))
    return rows.select(
        F.col("r.provider_label").alias("provider_label"),
        F.col("r.benthic_attribute_name").alias("attribute_name"),
        F.coalesce("r.growth_form_name", F.lit("")).alias("form_name"),
        F.col("provider_id"),
        F.col("r.benthic_attribute_id").alias("attribute_id"),
        F.coalesce("r.growth_form_id", F.lit("")).alias("form_id"),
    )


def read_label_names(spark: SparkSession, path: str, used: DataFrame) -> DataFrame:
    """(id, name) of a label file, restricted to the labels in ``used(label)``."""
    names = read_text_csv(spark, path).select("id", "name")
    return names.join(used.select(F.col("label").alias("id")).distinct(), "id", "left_semi")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points with optional label and score columns; an absent label column reads ``'None'``."""
    df = read_text_csv(spark, path)
    label = F.col("label") if "label" in df.columns else F.lit("None")
    score = F.nullif(F.col("score"), F.lit("")) if "score" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.col("row").cast("int").alias("row"),
        F.col("column").cast("int").alias("column"),
        label.alias("label"),
        score.cast("double").alias("score"),
    )
