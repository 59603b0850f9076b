"""Label mapping, form normalisation, rollup, filtering and the counts reported along the way."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from quadrat.functions.keys import NO_FORM
from quadrat.operators.staging import pin

CLASS = ["attribute_id", "form_id"]
POINT_KEY = ["site", "project_id", "image_id", "row", "col"]
PHYSICAL_KEY = ["bucket", "feature_vector", "row", "col"]

# Rows that one task counts by feature path: some 100 MB of paths.
ROWS_AT_ONCE = 500_000


# --- counts -----------------------------------------------------------------------------------


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"))


def stage_counts(df: DataFrame, stage: str) -> DataFrame:
    """One row: stage, annotations, distinct images (by feature path)."""
    images = per_image(df.select("feature_vector"), F.count(F.lit(1)).alias("points"))
    return images.agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("annotations"), F.count("feature_vector").alias("images")
    ).select(F.lit(stage).alias("stage"), "annotations", "images")


def per_image(df: DataFrame, *counts: Column) -> DataFrame:
    """``counts`` by feature path, in tasks of some ``ROWS_AT_ONCE`` rows.

    Nearly every row may have a path of its own, so what a task holds is bounded by its rows: they are written and counted once and
    dealt over as many tasks as that takes, and nothing is held while they are dealt.
    """
    seen = Observation()
    rows = pin(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(seen.get.get("rows") or 0) // ROWS_AT_ONCE))
    return rows.repartition(tasks, "feature_vector").groupBy("feature_vector").agg(*counts)


def split_counts() -> list[Column]:
    return [
        F.count_if(F.col("training_set") == "train").alias("train"),
        F.count_if(F.col("training_set") == "ref").alias("ref"),
        F.count_if(F.col("training_set") == "val").alias("val"),
        F.count_if(F.col("training_set").isNull()).alias("dropped"),
    ]


def project_stats(df: DataFrame, site: str | None = None, with_splits: bool = False) -> DataFrame:
    """Images and annotations per (site, project), later sites first.

    Counting goes through (site, project, image) partial counts, so a project that holds a third
    of the rows is spread over its images before its totals meet.
    """
    if site is not None:
        df = df.where(F.col("site") == site)
    parts = [F.count(F.lit(1)).alias("num_annotations")] + (split_counts() if with_splits else [])
    per_image = df.groupBy("site", "project_id", "image_id").agg(*parts)
    sums = [F.sum(c).alias(c) for c in per_image.columns[3:]]
    stats = per_image.groupBy("site", "project_id").agg(F.count("image_id").alias("num_images"), *sums)
    return stats.orderBy(F.desc("site"), "project_id")


def source_id_list(df: DataFrame) -> DataFrame:
    """Distinct project ids in numeric order."""
    return df.select("project_id").distinct().orderBy(F.col("project_id").cast("int"))


def retention(before: DataFrame, rolled: DataFrame, filtered: DataFrame) -> DataFrame:
    """Counts before rollup, after rollup and after filtering, with losses and percent kept."""
    stages = (
        stage_counts(before, "before")
        .unionByName(stage_counts(rolled, "rollup"))
        .unionByName(stage_counts(filtered, "filter"))
    )

    def at(stage: str, column: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(column)))

    one = stages.agg(
        *[
            at(s, c).alias(f"{c}_{s}")
            for c in ("annotations", "images")
            for s in ("before", "rollup", "filter")
        ]
    )
    return _losses(one)


def _losses(one: DataFrame) -> DataFrame:
    for c in ("annotations", "images"):
        base = F.greatest(F.col(f"{c}_before"), F.lit(1))
        one = (
            one.withColumn(f"{c}_lost_rollup", F.col(f"{c}_before") - F.col(f"{c}_rollup"))
            .withColumn(f"{c}_lost_filter", F.col(f"{c}_rollup") - F.col(f"{c}_filter"))
            .withColumn(f"{c}_kept_pct", F.lit(100.0) * F.col(f"{c}_filter") / base)
        )
    return one


def mark_kept(df: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The rows with ``_kept``: whether ``filter_classes`` would keep them."""
    if include is not None and exclude is not None:
        raise ValueError("A list of classes to keep and a list of classes to leave out exclude each other.")
    spec = include if include is not None else exclude
    if spec is None:
        return df.withColumn("_kept", F.lit(True))
    listed = spec.select(*CLASS).distinct().withColumn("_listed", F.lit(True))
    found = F.coalesce("_listed", F.lit(False))
    return df.join(listed, CLASS, "left").select(*df.columns, (found if include is not None else ~found).alias("_kept"))


def retention_of_marked(marked: DataFrame) -> DataFrame:
    """``retention`` of rolled-up rows that carry ``_kept``, in one pass: a rollup keeps every row and image."""
    images = per_image(
        marked.select("feature_vector", "_kept"), F.count(F.lit(1)).alias("all"), F.count_if("_kept").alias("kept")
    )
    one = images.agg(
        F.coalesce(F.sum("all"), F.lit(0)).alias("annotations_before"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("annotations_filter"),
        F.count("feature_vector").alias("images_before"),
        F.count_if(F.col("feature_vector").isNotNull() & (F.col("kept") > 0)).alias("images_filter"),
    )
    for c in ("annotations", "images"):
        one = one.withColumn(f"{c}_rollup", F.col(f"{c}_before"))
    return _losses(
        one.select(*[f"{c}_{s}" for c in ("annotations", "images") for s in ("before", "rollup", "filter")])
    )


# --- columns by distinct value ----------------------------------------------------------------


def map_distinct(
    df: DataFrame,
    column: str,
    fn: Callable[[Column], Column] | Callable[[object], object],
    new: str | None = None,
    returns: str | DataType | None = None,
) -> DataFrame:
    """Set ``new`` (default: ``column``) to ``fn(column)``; rows with a NULL ``column`` drop.

    Without ``returns``, ``fn`` builds a column expression and runs in place. With ``returns`` it
    is a Python function, evaluated once per distinct value and joined back.
    """
    target = new or column
    if returns is None:
        return df.where(F.col(column).isNotNull()).withColumn(target, fn(F.col(column)))

    @F.pandas_udf(returns)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(fn)

    apply_to = df.where(F.col(column).isNotNull()).select(column).distinct()
    looked_up = apply_to.select(F.col(column), apply(F.col(column)).alias("_mapped"))
    joined = df.join(looked_up, column)
    kept = [F.col("_mapped").alias(c) if c == target else F.col(c) for c in df.columns]
    if target not in df.columns:
        kept.append(F.col("_mapped").alias(target))
    return joined.select(*kept)


def keep_where(
    df: DataFrame,
    column: str,
    accepts: Callable[[Column], Column] | Callable[[object], bool],
    python: bool = False,
) -> DataFrame:
    """Rows whose ``column`` passes ``accepts``, an expression or a Python predicate."""
    if not python:
        return df.where(accepts(F.col(column)))
    flagged = map_distinct(df.select(column).distinct(), column, accepts, "_keep", "boolean")
    return df.join(flagged.where("_keep"), column, "left_semi")


def replace_column(df: DataFrame, column: str, values: str) -> DataFrame:
    """Put the values of ``values`` in place of ``column`` and drop the spare column."""
    return df.withColumn(column, F.col(values)).drop(values)


# --- classes ----------------------------------------------------------------------------------


def require_one_row(table: DataFrame, key: list[str], what: str) -> None:
    """Raise if two different rows of a lookup table have the same key; equal rows count as one."""
    twice = table.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).limit(3).collect()
    if twice:
        raise ValueError(f"The {what} has different rows for {[tuple(r)[:-1] for r in twice]}.")


def map_labels(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add the class of ``label_id``; an unmapped label gives NULL, a NULL label drops the row."""
    return look_up_labels(df.where(F.col("label_id").isNotNull()), mapping)


def look_up_labels(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add the class of ``label_id``; an unmapped or NULL label gives NULL. Keeps every row, once."""
    require_one_row(mapping, ["provider_id"], "label mapping")
    lookup = mapping.select(
        F.col("provider_id").alias("label_id"), "attribute_id", F.coalesce("form_id", F.lit(NO_FORM)).alias("form_id")
    ).distinct()
    rest = [c for c in df.columns if c != "label_id"]
    return df.join(lookup, "label_id", "left").select(*rest, "label_id", *CLASS)


def unmapped_labels(df: DataFrame) -> DataFrame:
    """Labels without a class: annotations and projects, most annotated first."""
    per_project = (
        df.where(F.col("attribute_id").isNull())
        .groupBy("label_id", "project_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_project.groupBy("label_id")
        .agg(F.sum("n").alias("num_annotations"), F.count("project_id").alias("num_projects"))
        .orderBy(F.desc("num_annotations"), "label_id")
    )


def drop_unmapped(df: DataFrame) -> DataFrame:
    return df.where(F.col("attribute_id").isNotNull())


def normal_forms(df: DataFrame) -> DataFrame:
    """The text ``None`` as form becomes ``''``; rows with a NULL form drop."""
    return map_distinct(df, "form_id", lambda c: F.when(c == "None", NO_FORM).otherwise(c))


def clear_forms(df: DataFrame) -> DataFrame:
    return df.where(F.col("form_id").isNotNull()).withColumn("form_id", F.lit(NO_FORM))


def append_native(provider: DataFrame | None, native: DataFrame) -> DataFrame:
    """Union by column name; columns that one side lacks are NULL."""
    if provider is None:
        return native
    return provider.unionByName(native, allowMissingColumns=True)


def roll_up(df: DataFrame, spec: DataFrame | None) -> DataFrame:
    """Replace each class by its rollup target, looked up once; classes without a rule stay."""
    if spec is None:
        return df
    require_one_row(spec, ["from_attribute_id", "from_form_id"], "rollup")
    rules = spec.distinct().select(
        F.col("from_attribute_id").alias("attribute_id"),
        F.col("from_form_id").alias("form_id"),
        F.struct("to_attribute_id", "to_form_id").alias("_to"),
    )
    joined = df.join(rules, CLASS, "left")
    to = {
        "attribute_id": F.coalesce("_to.to_attribute_id", "attribute_id"),
        "form_id": F.coalesce("_to.to_form_id", "form_id"),
    }
    return joined.select(*[to[c].alias(c) if c in to else F.col(c) for c in df.columns])


def filter_classes(
    df: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None
) -> DataFrame:
    """Keep the included classes, or all but the excluded ones; no spec keeps all."""
    if include is not None and exclude is not None:
        raise ValueError("A list of classes to keep and a list of classes to leave out exclude each other.")
    if include is not None:
        return df.join(include, CLASS, "left_semi").select(*df.columns)
    if exclude is not None:
        return df.join(exclude, CLASS, "left_anti").select(*df.columns)
    return df


