"""Deterministic per-class subsampling and its audit table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.allocate import SubsampleOptions, class_targets
from quadrat.operators.prepare import CLASS, POINT_KEY, class_counts
from quadrat.operators.ranking import ranked
from quadrat.operators.staging import pin


# So many columns at the start of the order make a row's lead: the place of a point's source.
LEAD = 2


def cap_classes(
    df: DataFrame, targets: DataFrame, order: Sequence[str | Column] = POINT_KEY, leads: DataFrame | None = None
) -> DataFrame:
    """The first ``target_n`` rows of each class along ``order``; classes without target drop.

    ``targets`` is a pinned class table with the class size ``n``. Classes that are kept whole stay where they are read. Of a class that is cut,
    ``leads`` (``lead_counts``, pinned) tells at which lead, the first ``LEAD`` columns of the order, the cut lies: rows of earlier leads are
    kept and those of later ones dropped where they are read, and only the rows of that one lead are ranked and shuffled.
    The rank itself is distributed: no task holds a whole class.
    """
    cut = (F.col("target_n") < F.col("n")) & (F.col("target_n") > 0)
    whole = F.col("target_n") >= F.col("n")
    some = targets.agg(F.count_if(cut), F.count_if(whole & (F.col("n") > 0))).first()
    columns, keys = list(df.columns), [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.join(targets.select(*CLASS, "n", "target_n"), CLASS)
    if not some[0]:
        return named.where(whole).select(*columns)
    leads = pin(lead_counts(df, order)) if leads is None else leads
    bounds = pin(_cut_leads(leads, targets.where(cut)))
    own, last = _lead(keys), F.col("_last")
    placed = df.join(bounds, CLASS)
    parts = [placed.where(own < last).select(*columns)]
    if some[1]:
        parts.append(named.where(whole).select(*columns))
    if not bounds.where("_left < _rows").isEmpty():
        edge = ranked(placed.where((own == last) & (F.col("_left") < F.col("_rows"))), CLASS, order, "_rn")
        parts.append(edge.where(F.col("_rn") <= F.col("_left")).select(*columns))
    parts.append(placed.where((own == last) & (F.col("_left") >= F.col("_rows"))).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def _lead(keys: Sequence[Column]) -> Column:
    # Structs are compared field by field, NULL first, as rows are sorted.
    return F.struct(*[key.alias(f"_l{i}") for i, key in enumerate(keys[:LEAD])])


def lead_counts(df: DataFrame, order: Sequence[str | Column] = POINT_KEY) -> DataFrame:
    """Rows (``_rows``) per class and lead (``_lead``) of the order; for points a lead is a source."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.select(*CLASS, _lead(keys).alias("_lead")).groupBy(*CLASS, "_lead").agg(F.count(F.lit(1)).alias("_rows"))


def _cut_leads(leads: DataFrame, targets: DataFrame) -> DataFrame:
    """Per class the lead in which its target ends (``_last``), that lead's rows, and how many of them belong to the target (``_left``)."""
    earlier = Window.partitionBy(*CLASS).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    counted = leads.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).join(
        targets.select(*CLASS, "target_n"), CLASS
    )
    holds = (F.col("_before") < F.col("target_n")) & (F.col("target_n") <= F.col("_before") + F.col("_rows"))
    return counted.where(holds).select(
        *CLASS, F.col("_lead").alias("_last"), "_rows", (F.col("target_n") - F.col("_before")).alias("_left")
    )


def subsample(
    df: DataFrame,
    options: SubsampleOptions,
    order: Sequence[str | Column] = POINT_KEY,
    counts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, class targets). The same rows are kept for any parallelism."""
    leads = pin(lead_counts(df, order))
    counts = counts if counts is not None else leads.groupBy(*CLASS).agg(F.sum("_rows").alias("n"))
    targets = pin(class_targets(options, pin(counts)))
    return cap_classes(df, targets, order, leads), targets


def audit(targets: DataFrame, kept: DataFrame) -> DataFrame:
    """Per class: rows before, target, rows kept."""
    realized = class_counts(kept).withColumnRenamed("n", "realized_n")
    return targets.join(realized, CLASS, "left").select(
        *CLASS,
        F.col("n").alias("pre_count"),
        "target_n",
        F.coalesce("realized_n", F.lit(0)).alias("realized_n"),
    )


def realized_total(audited: DataFrame) -> DataFrame:
    return audited.agg(F.sum("realized_n").alias("realized_total"))
