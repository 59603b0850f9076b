"""Equal-mass calibration error: rows are cut by rank of their score into bins of equal size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.ranking import ranked
from quadrat.operators.staging import pin

N_BINS = 20
MIN_CATEGORY = 30

# Steps of the score by which rows are counted before any is ranked.
STEPS = 1 << 16

SUMS = ("count", "score_sum", "hit_sum", "conf_min", "conf_max")


def scored_rows(predictions: DataFrame, key: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """The columns that binning needs; ``key`` orders rows of equal score."""
    cols = [F.col(c) if isinstance(c, str) else c for c in key]
    return predictions.select(
        *by,
        F.col("score"),
        (F.col("gt") == F.col("est")).cast("long").alias("hit"),
        *[c.alias(f"_key{i}") for i, c in enumerate(cols)],
    )


def equal_mass_bins(
    rows: DataFrame, n_bins: Column, by: Sequence[str] = (), sizes: DataFrame | None = None
) -> DataFrame:
    """(by..., bin, count, sums and bounds): bin ``i`` holds ranks floor(i*n/B) to floor((i+1)*n/B).

    ``n_bins`` may use the group size ``_n``. ``sizes(by..., _n)``, if given, says which groups count.

    Rows are counted and summed by steps of the score, ``STEPS`` of them between 0 and 1. A step that lies in one bin counts there as a whole; only
    the rows of steps at which a bin ends are ranked, over range-partitioned chunks, so neither the whole table nor a large
    category is sorted in one place.
    """
    stepped = rows.withColumn("_step", _step(F.col("score")))
    sums = pin(stepped.groupBy(*by, "_step").agg(*_sums()))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("_earlier", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    if by and sizes is not None:
        placed = placed.join(sizes, list(by))
    else:
        placed = placed.withColumn("_n", F.sum("count").over(group))
    placed = placed.withColumn("_bins", n_bins.cast("long"))

    def at(rank: Column) -> Column:
        return F.call_function("div", rank * F.col("_bins") - 1, F.col("_n"))

    first, last = at(F.col("_earlier") + 1), at(F.col("_earlier") + F.col("count"))
    placed = pin(placed.withColumn("bin", first).withColumn("_cut", first != last))
    edges = placed.where("_cut").select(*by, "_step", "_earlier", "_n", "_bins")
    parts = placed.where(~F.col("_cut")).select(*by, "bin", *SUMS)
    if not edges.isEmpty():
        keys = [*by, "_step"]
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys])
        named = edges.select(*[F.col(k).alias(f"_e_{k}") for k in keys], "_earlier", "_n", "_bins")
        mixed = stepped.join(named, on).drop(*[f"_e_{k}" for k in keys])
        order = ["score", *[c for c in rows.columns if c.startswith("_key")]]
        ends = ranked(mixed, keys, order, "_rn").groupBy(*by, at(F.col("_earlier") + F.col("_rn")).alias("bin")).agg(*_sums())
        parts = parts.unionByName(ends)
    merge = {"conf_min": F.min, "conf_max": F.max}
    return parts.groupBy(*by, "bin").agg(*[merge.get(c, F.sum)(c).alias(c) for c in SUMS])


def _step(score: Column) -> Column:
    """A number that grows with the score, as rows are sorted: NULL first, NaN last."""
    number = F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor(score * STEPS)))
    return F.when(score.isNull(), -1).when(F.isnan(score), STEPS + 1).otherwise(number).cast("int")


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        F.sum("score").alias("score_sum"),
        F.sum("hit").alias("hit_sum"),
        F.min("score").alias("conf_min"),
        F.max("score").alias("conf_max"),
    ]


def bin_table(bins: DataFrame) -> DataFrame:
    """Bins numbered from 1 over the non-empty ones, with confidence, accuracy and their gap."""
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bin"))
    conf, acc = F.col("score_sum") / F.col("count"), F.col("hit_sum") / F.col("count")
    return bins.select(
        number.alias("bin"),
        "conf_min",
        "conf_max",
        conf.alias("avg_confidence"),
        acc.alias("avg_accuracy"),
        (conf - acc).alias("gap"),
        "count",
    ).orderBy("bin")


def _ece() -> Column:
    gap = F.abs(F.col("hit_sum") - F.col("score_sum"))
    return F.coalesce(F.try_divide(F.sum(gap), F.sum("count")), F.lit(0.0))


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg(_ece().alias("ece"))


def category_ece(rows: DataFrame, classes: DataFrame, min_samples: int = MIN_CATEGORY) -> DataFrame:
    """Calibration error per root category, largest first; ``rows`` carry ``gt``.

    Categories have ``min(20, max(2, n div 10))`` bins; those below ``min_samples`` are left out.
    """
    cats = classes.select(F.col("class_id").alias("gt"), "root", F.col("root_name").alias("category"))
    named = pin(rows.join(cats, "gt").drop("gt"))
    sizes = named.groupBy("root", "category").agg(F.count(F.lit(1)).alias("_n"))
    sizes = pin(sizes.where(F.col("_n") >= min_samples))
    n_bins = F.least(F.lit(N_BINS), F.greatest(F.lit(2), F.floor(F.col("_n") / 10)))
    bins = equal_mass_bins(named, n_bins, ["root", "category"], sizes)
    return (
        bins.groupBy("root", "category")
        .agg(
            _ece().alias("ece"),
            (F.sum("hit_sum") / F.sum("count")).alias("accuracy"),
            (F.sum("score_sum") / F.sum("count")).alias("avg_confidence"),
            F.sum("count").alias("n_samples"),
        )
        .select("category", "ece", "accuracy", "avg_confidence", "n_samples")
        .orderBy(F.desc("ece"), "category")
    )
