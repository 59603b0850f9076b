"""Run logs: early-stopping bookkeeping, epoch metrics, counters, fingerprints, headline tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.numbers import LIBRARY_EPS, argmax
from quadrat.operators.ranking import range_chunks, ranked
from quadrat.operators.staging import pin

# Names of the headline metrics by section, in report order. The labels are our own.
HEADLINE = (
    ("executive", "accuracy", "Share of correct points"),
    ("executive", "balanced_accuracy", "Mean recall over classes"),
    ("executive", "f1_macro", "Macro F1"),
    ("executive", "precision_macro", "Macro precision"),
    ("executive", "recall_macro", "Macro recall"),
    ("executive", "mcc", "Matthews correlation"),
    ("executive", "ece", "Calibration error"),
    ("executive", "log_loss", "Logarithmic loss"),
    ("topk", "top_1_accuracy", "True class first"),
    ("topk", "top_3_accuracy", "True class among 3"),
    ("topk", "top_5_accuracy", "True class among 5"),
    ("topk", "top_10_accuracy", "True class among 10"),
    ("topk", "mrr", "Mean reciprocal rank"),
    ("topk", "hierarchical_top_5_mean_similarity", "Best similarity among 5"),
    ("cover", "cover_mean_abs_bias_pct", "Cover bias, mean size"),
    ("cover", "cover_mean_rmse_pct", "Cover error, root mean square"),
    ("cover", "cover_mean_mae_pct", "Cover error, mean size"),
    ("cover", "cover_median_r_squared", "Cover fit, median"),
    ("taxonomic", "cross_branch_error_rate", "Errors across branches"),
    ("taxonomic", "within_branch_error_rate", "Errors within a branch"),
    ("taxonomic", "gf_accuracy_gf_relevant", "Form accuracy where forms matter"),
    ("taxonomic", "within_ba_gf_accuracy", "Form accuracy within an attribute"),
)


def best_so_far(log: DataFrame) -> DataFrame:
    """Add ``best_loss``, ``best_epoch`` and ``since_best`` to (run_id, epoch, val_loss).

    The best is the smallest loss up to the epoch, the earliest epoch among equals (an improvement
    is strict). The log is cut into epoch chunks of even size, so no task holds a whole run; the best of a run's earlier
    chunks is carried in as one value per chunk.
    """
    usable = F.col("val_loss").isNotNull() & ~F.isnan("val_loss")
    state = F.when(usable, F.struct(F.col("val_loss").alias("loss"), F.col("epoch").alias("epoch")))
    chunks = range_chunks(log, [F.col("run_id"), F.col("epoch")])
    earlier = Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = pin(
        chunks.groupBy("run_id", "_chunk")
        .agg(F.min(state).alias("_chunk_best"))
        .withColumn("_carried", F.min("_chunk_best").over(earlier))
        .select("run_id", "_chunk", "_carried.loss", F.col("_carried.epoch").alias("_epoch"))
    )
    carried_best = F.when(F.col("loss").isNotNull(), F.struct("loss", F.col("_epoch").alias("epoch")))
    upto = Window.partitionBy("run_id", "_chunk").orderBy("epoch").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    marked = (
        chunks.join(carried, ["run_id", "_chunk"])
        .withColumn("_own", F.min(state).over(upto))
        .withColumn("_best", F.array_min(F.array_compact(F.array("_own", carried_best))))
    )
    best_epoch = F.col("_best.epoch")
    return marked.select(
        *log.columns,
        F.col("_best.loss").alias("best_loss"),
        best_epoch.alias("best_epoch"),
        # Before any usable loss every epoch counts as one without improvement.
        (F.col("epoch") - F.coalesce(best_epoch, F.lit(-1))).alias("since_best"),
    )


def early_stopping(log: DataFrame, patience: int) -> DataFrame:
    """Per run: the epoch count at the stop, whether it stopped early, best epoch and loss then.

    Epochs are 0-based and consecutive; ``final_epoch`` and ``best_val_epoch`` are 1-based. The
    stop is the first epoch at which ``patience`` epochs have passed without an improvement.
    """
    marked = best_so_far(log)
    stopped = F.col("since_best") >= patience
    at = F.struct("epoch", "best_epoch", "best_loss")
    ends = marked.groupBy("run_id").agg(
        F.min_by(at, F.when(stopped, F.col("epoch"))).alias("_stop"),
        F.max_by(at, "epoch").alias("_last"),
    )
    end = F.coalesce("_stop", "_last")
    return ends.select(
        "run_id",
        (end["epoch"] + 1).alias("final_epoch"),
        F.col("_stop").isNotNull().alias("early_stopped"),
        (end["best_epoch"] + 1).alias("best_val_epoch"),
        end["best_loss"].alias("best_val_loss"),
    )


def numbered_epochs(log: DataFrame, run: str, order: Sequence[str | Column]) -> DataFrame:
    """Number the entries of each run from 0 in the given order."""
    return ranked(log, [run], order, "_rn").withColumn("epoch", F.col("_rn") - 1).drop("_rn")


def epoch_metrics(predictions: DataFrame, by: Sequence[str] = ("run_id", "epoch", "split")) -> DataFrame:
    """Accuracy and log loss per run, epoch and split from (gt index, proba) rows."""
    p_true = F.get("proba", F.col("gt"))
    clipped = F.least(F.greatest(p_true, F.lit(LIBRARY_EPS)), F.lit(1 - LIBRARY_EPS))
    return predictions.groupBy(*by).agg(
        F.avg((argmax(F.col("proba")) == F.col("gt")).cast("double")).alias("accuracy"),
        F.avg(-F.ln(clipped)).alias("log_loss"),
        F.count(F.lit(1)).alias("n"),
    )


def outcome_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes when any row of the table does, and does not depend on row order.

    Each row's JSON is hashed; two 48-bit pieces of the hash are summed over all rows.
    """
    row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    pieces = df.select(
        *[F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(20,0)").alias(f"p{i}") for i, at in enumerate((1, 13))]
    )
    sums = pieces.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("string").alias(c) for c in pieces.columns],
    )
    return sums.select(
        F.col("n").alias("rows"),
        F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), "p0", "p1"), 256), 1, 10).alias(
            "fingerprint"
        ),
    )


def headline(scalars: DataFrame) -> DataFrame:
    """Named scalars in report order by group; absent ones are left out."""
    spec = scalars.sparkSession.createDataFrame(
        [(i, *row) for i, row in enumerate(HEADLINE)], "position int, section string, name string, label string"
    )
    return (
        spec.join(scalars, "name")
        .select("position", "section", "name", "label", "value")
        .orderBy("position")
    )


def labels_for_review(per_label: DataFrame) -> DataFrame:
    """Per-label metrics, weakest F1 first."""
    return per_label.orderBy("f1_score", "class_id")


def shards(items: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Deal a work list round robin into ``n`` shards (column ``shard``); empty shards vanish."""
    if n < 1:
        raise ValueError(f"A work list cannot be dealt into {n} shards.")
    numbered = ranked(items, [], order, "_rn")
    return numbered.withColumn("shard", ((F.col("_rn") - 1) % n).cast("int")).drop("_rn")
