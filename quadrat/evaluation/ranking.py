"""Rank of the true class, top-k accuracy, reciprocal rank and taxonomic top-k similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.evaluation.probability import with_class
from quadrat.functions.numbers import top_classes, true_rank
from quadrat.operators.taxonomy import by_root, similarity

KS = (1, 3, 5, 10)
# Similarity thresholds and the column that each fills.
THRESHOLDS = ((1.0, "hit_exact"), (0.75, "hit_sibling_0.75"), (0.5, "hit_family_0.5"))


def with_rank(probs: DataFrame) -> DataFrame:
    return probs.withColumn("rank", true_rank(F.col("proba"), F.col("gt_idx")))


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def topk_scalars(ranks: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    return ranks.agg(
        *[_share(F.col("rank") <= k).alias(f"top_{k}_accuracy") for k in ks],
        F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"),
    )


def category_topk(
    ranks: DataFrame, classes: DataFrame, ks: Sequence[int] = KS, min_samples: int = 30
) -> DataFrame:
    """Top-k accuracy and reciprocal rank per root category, best top-1 first."""
    aggs = [_share(F.col("rank") <= k).alias(f"top_{k}") for k in ks]
    table = by_root(
        with_class(ranks, classes),
        classes,
        *aggs,
        F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"),
        min_samples=min_samples,
    )
    return table.select("category", *[f"top_{k}" for k in ks], "mrr", "n_samples").orderBy(
        F.desc("top_1"), "category"
    )


def similarity_rows(classes: DataFrame) -> DataFrame:
    """(gt_idx, sims): similarity of each class to every class, in class order. K rows of K values."""
    every = F.collect_list(F.struct("idx", "path")).over(Window.partitionBy(F.lit(0)))
    ordered = F.array_sort(every)
    return classes.select(F.col("idx").alias("gt_idx"), F.col("path"), ordered.alias("_all")).select(
        "gt_idx",
        F.transform("_all", lambda other: similarity(F.col("path"), other["path"])).alias("sims"),
    )


def best_similarity(probs: DataFrame, classes: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Per sample the best similarity to the true class within its first k classes (``sim_k``).

    The similarities arrive as one array per true class, so no sample is exploded or shuffled.
    """
    top = top_classes(F.col("proba"), max(ks))
    joined = probs.withColumn("_top", top).join(similarity_rows(classes), "gt_idx")
    found = joined.withColumn("_found", F.transform("_top", lambda i: F.get("sims", i)))
    return found.select(
        *probs.columns, *[F.array_max(F.slice("_found", 1, k)).alias(f"sim_{k}") for k in ks]
    )


def hierarchical_topk(best: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """One row per k: mean best similarity and the share at or above each threshold."""
    one = best.agg(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.avg(f"sim_{k}").alias("mean_max_similarity"),
                *[_share(F.col(f"sim_{k}") >= t).alias(name) for t, name in THRESHOLDS],
            ).alias(f"_{k}")
            for k in ks
        ]
    )
    return one.select(F.inline(F.array(*[f"_{k}" for k in ks]))).orderBy("k")
