"""Building a rollup specification: each mapped class goes to its nearest target ancestor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.keys import NO_FORM
from quadrat.functions.text import KEPT_FORMS, inherent_form, kept_form
from quadrat.operators.taxonomy import closure

# Names that never become targets, whatever the target list says.
EXCLUDED_NAMES = ("Dead coral", "Bleached coral", "Other invertebrates")


def flagged_names(labels: DataFrame, flag: str = "top100") -> DataFrame:
    """Rows of a label list whose flag is 1; an absent flag counts as 0."""
    return labels.where(F.coalesce(F.col(flag).cast("double").cast("int"), F.lit(0)) == 1)


def resolve_targets(
    names: DataFrame, nodes: DataFrame, excluded: Sequence[str] = EXCLUDED_NAMES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(target ids, unresolved names, excluded names that were listed)."""
    listed = names.select("name")
    allowed = listed.where(~F.col("name").isin(*excluded))
    ids = nodes.join(allowed, "name", "left_semi").select("id")
    return (
        ids,
        allowed.join(nodes.select("name"), "name", "left_anti"),
        listed.where(F.col("name").isin(*excluded)),
    )


def excluded_ids(nodes: DataFrame, excluded: Sequence[str] = EXCLUDED_NAMES) -> DataFrame:
    return nodes.where(F.col("name").isin(*excluded)).select("id")


def nearest_targets(walked: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, target): the nearest member of ``targets`` going up from the node, itself first."""
    up = closure(walked).join(targets.select(F.col("id").alias("ancestor")), "ancestor")
    return up.groupBy("id").agg(F.min_by("ancestor", "distance").alias("target"))


def inherent_forms(labels: DataFrame, column: str = "growth forms") -> DataFrame:
    """(id, inherent) of label rows with one listed form; lists of choices are left out."""
    if column not in labels.columns:
        return labels.select("id", F.lit(None).cast("string").alias("inherent")).limit(0)
    return labels.select("id", inherent_form(F.col(f"`{column}`")).alias("inherent")).where(
        F.col("inherent").isNotNull()
    )


def classify_mapping(
    mapping: DataFrame,
    walked: DataFrame,
    forms: DataFrame,
    targets: DataFrame,
    excluded: DataFrame,
    designated: str | None = None,
    inherent: DataFrame | None = None,
    kept: Sequence[str] = KEPT_FORMS,
) -> DataFrame:
    """Each mapping entry with its drop reason, or its rollup target class.

    Reasons, tested in this order: ``null``, ``excluded``, ``unknown``, ``no_target``. Only the
    ``designated`` target keeps forms: the entry's own form if given, else the attribute's inherent
    form, each reduced to the kept forms. Every other target clears the form.
    """
    entries = mapping.select(
        "provider_id", "attribute_id", F.coalesce("form_id", F.lit(NO_FORM)).alias("form_id")
    )
    known = walked.select(F.col("id").alias("attribute_id"), F.lit(True).alias("_known"))
    barred = excluded.select(F.col("id").alias("attribute_id"), F.lit(True).alias("_barred")).distinct()
    nearest = nearest_targets(walked, targets).select(F.col("id").alias("attribute_id"), "target")
    form_of = forms.select(F.col("id").alias("form_id"), F.col("name").alias("_form"))
    if inherent is None:
        inherent = walked.select("id", F.lit(None).cast("string").alias("inherent")).limit(0)
    own = inherent.select(F.col("id").alias("attribute_id"), "inherent")
    bucket_ids = forms.where(F.col("name").isin(*kept)).select(
        F.col("name").alias("_bucket"), F.col("id").alias("_bucket_id")
    )
    blank = F.coalesce(F.col("attribute_id"), F.lit("")) == ""
    reason = (
        F.when(blank, "null")
        .when(F.col("_barred"), "excluded")
        .when(F.col("_known").isNull(), "unknown")
        .when(F.col("target").isNull(), "no_target")
    )
    special = F.col("target") == F.lit(designated)
    bucket = (
        F.when(F.col("form_id") != NO_FORM, kept_form(F.col("_form"), kept))
        .when(F.col("attribute_id") == F.lit(designated), NO_FORM)
        .otherwise(F.coalesce("inherent", F.lit(NO_FORM)))
    )
    joined = (
        entries.join(known, "attribute_id", "left")
        .join(barred, "attribute_id", "left")
        .join(nearest, "attribute_id", "left")
        .join(form_of, "form_id", "left")
        .join(own, "attribute_id", "left")
        .withColumn("reason", reason)
        .withColumn("_bucket", F.when(special, bucket).otherwise(NO_FORM))
    )
    return joined.join(bucket_ids, "_bucket", "left").select(
        "provider_id",
        "attribute_id",
        "form_id",
        "reason",
        F.when(F.col("reason").isNull(), F.col("target")).alias("to_attribute_id"),
        F.when(F.col("reason").isNull(), F.coalesce("_bucket_id", F.lit(NO_FORM))).alias("to_form_id"),
        F.when(F.col("reason").isNull(), F.col("_bucket")).alias("to_form_name"),
    )


def rollup_rows(classified: DataFrame) -> DataFrame:
    """Distinct rollup rows, identity rows left out."""
    same = (F.col("attribute_id") == F.col("to_attribute_id")) & (F.col("form_id") == F.col("to_form_id"))
    return (
        classified.where(F.col("reason").isNull() & ~same)
        .select(
            F.col("attribute_id").alias("from_attribute_id"),
            F.col("form_id").alias("from_form_id"),
            "to_attribute_id",
            "to_form_id",
            "to_form_name",
        )
        .distinct()
        .orderBy("from_attribute_id", "from_form_id", "to_attribute_id", "to_form_id")
    )


def drop_reasons(classified: DataFrame) -> DataFrame:
    return (
        classified.where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("entries"))
    )


def rollup_breakdown(rows: DataFrame, designated: str | None = None) -> DataFrame:
    """One row of counters over the distinct rollup rows."""
    stays = F.col("from_attribute_id") == F.col("to_attribute_id")
    special = F.col("to_attribute_id") == F.lit(designated)
    inner = special & ~stays
    # The two kept forms have a counter each.
    return rows.agg(
        F.count_if(stays).alias("form_collapse"),
        F.count_if(~stays).alias("cross_attribute"),
        F.count_if(special & stays).alias("designated_form_collapse"),
        F.count_if(inner & (F.col("to_form_name") == "Branching")).alias("designated_to_branching"),
        F.count_if(inner & (F.col("to_form_name") == "Massive")).alias("designated_to_massive"),
        F.count_if(inner & (F.col("to_form_name") == NO_FORM)).alias("designated_to_other"),
    )


def included_rows(
    targets: DataFrame, forms: DataFrame, designated: str | None = None, kept: Sequence[str] = KEPT_FORMS
) -> DataFrame:
    """Target classes without form, plus the kept forms of the designated target."""
    plain = targets.select(F.col("id").alias("attribute_id"), F.lit(NO_FORM).alias("form_id"))
    kept_ids = forms.where(F.col("name").isin(*kept)).select(
        F.lit(designated).alias("attribute_id"), F.col("id").alias("form_id")
    )
    extra = kept_ids.join(plain.select("attribute_id"), "attribute_id", "left_semi")
    return plain.unionByName(extra).distinct().orderBy("attribute_id", "form_id")


def rows_outside(rollups: DataFrame, included: DataFrame) -> DataFrame:
    """Rollup rows whose target attribute is not an included attribute; must be empty."""
    allowed = included.select(F.col("attribute_id").alias("to_attribute_id"))
    return rollups.join(allowed, "to_attribute_id", "left_anti")


def require_inside(rollups: DataFrame, included: DataFrame) -> None:
    bad = rows_outside(rollups, included).limit(1).collect()
    if bad:
        raise ValueError(
            f"rollup target {bad[0]['to_attribute_id']} (from {bad[0]['from_attribute_id']}) is not included"
        )
