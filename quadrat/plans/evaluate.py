"""Metric groups over one evaluation: each declares its inputs, and one that fails stops no other."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.evaluation import (
    calibration,
    classification,
    confusion,
    cover,
    forms,
    hierarchy,
    per_source,
    probability,
    ranking,
)
from quadrat.evaluation.probability import encode_labels, require_known_labels
from quadrat.functions.keys import source_key
from quadrat.functions.numbers import half_even
from quadrat.operators import scoring
from quadrat.operators.features import join_features, require_one_vector
from quadrat.operators.staging import pin, stage

logger = logging.getLogger(__name__)

# Groups under way at one time; most of their jobs are small, and would wait for one another.
AT_ONCE = 4


class InvalidEvaluation(ValueError):
    """The predictions do not fit the class list."""


@dataclass
class Evaluation:
    """Inputs: predictions (gt, est, score, key columns), class table, taxonomy paths, probabilities.

    ``has_sources`` says that predictions carry ``image_key`` and ``source_key``.
    """

    predictions: DataFrame
    classes: DataFrame
    walked: DataFrame
    key: Sequence[str]
    probs: DataFrame | None = None
    has_sources: bool = True
    cells: DataFrame | None = None

    _overall: DataFrame | None = None
    _counted: DataFrame | None = None
    _lock: Lock = field(default_factory=Lock)

    def counted(self) -> DataFrame:
        """Predictions counted by source, image and cell, which the confusion, cover and source metrics start from."""
        with self._lock:
            if self._counted is None:
                self._counted = pin(confusion.counted(self.predictions))
            return self._counted

    def overall(self) -> DataFrame:
        """The one row of overall scores, which two groups use."""
        with self._lock:
            if self._overall is None:
                self._overall = pin(classification.overall(self.cells))
            return self._overall

    def validate(self) -> None:
        if self.cells is None:
            source = self.counted() if self.has_sources else self.predictions
            self.cells = pin(confusion.confusion(source))
        if self.cells.isEmpty():
            raise InvalidEvaluation("There are no predictions.")
        known = self.classes.select("class_id")
        used = self.cells.select(F.col("gt").alias("class_id")).union(self.cells.select("est"))
        bad = used.distinct().join(known, "class_id", "left_anti").limit(3).collect()
        if bad:
            raise InvalidEvaluation(f"Classes not in the class list: {[r[0] for r in bad]}")


@dataclass
class GroupResult:
    """One-row tables of scalars, and the named tables of a metric group; a table may be given as what makes it when it is wanted."""

    scalars: list[DataFrame] = field(default_factory=list)
    tables: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)


def _confusion(ctx: Evaluation) -> GroupResult:
    full = confusion.full_confusion(ctx.cells, ctx.classes)
    return GroupResult(
        tables={
            "confusion_matrix/frequencies": lambda: confusion.wide_confusion(full, ctx.classes, "n"),
            "confusion_matrix/percents": lambda: confusion.wide_confusion(full, ctx.classes, "pct"),
        }
    )


def _rounded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[half_even(F.col(n)).alias(n) for n in names])


def _precision_recall(ctx: Evaluation) -> GroupResult:
    def labels() -> DataFrame:
        scores = classification.per_label(ctx.cells, ctx.classes)
        return scores.withColumns({c: half_even(F.col(c)) for c in ("precision", "recall", "f1_score")})

    macro = _rounded(ctx.overall(), ["precision_macro", "recall_macro", "f1_macro"])
    return GroupResult([macro], {"metrics_per_label": labels})


def _balanced(ctx: Evaluation) -> GroupResult:
    one = ctx.overall()
    return GroupResult([_rounded(one, ["balanced_accuracy", "mcc"]), one.select("accuracy")])


def _taxonomic(ctx: Evaluation) -> GroupResult:
    def attributed() -> DataFrame:
        return hierarchy.error_attribution(ctx.cells, ctx.classes, ctx.walked)

    formed = forms.form_cells(ctx.cells, ctx.classes)
    return GroupResult(
        [hierarchy.branch_error_rates(ctx.cells, ctx.classes), forms.form_accuracy(formed)],
        {
            "taxonomic/error_attribution": attributed,
            "taxonomic/branch_errors": lambda: hierarchy.branch_errors(attributed()),
            "taxonomic/top_level_confusions": lambda: hierarchy.root_confusions(hierarchy.root_confusion(ctx.cells, ctx.classes)),
            "taxonomic/gf_precision_recall_f1": lambda: forms.form_scores(formed),
            "taxonomic/gf_confusion": lambda: forms.form_confusion(formed),
        },
    )


def _calibration(ctx: Evaluation) -> GroupResult:
    rows = calibration.scored_rows(ctx.predictions, ctx.key)
    bins = pin(calibration.equal_mass_bins(rows, F.lit(calibration.N_BINS)))

    def by_category() -> DataFrame:
        return calibration.category_ece(calibration.scored_rows(ctx.predictions, ctx.key, ["gt"]), ctx.classes)

    return GroupResult(
        [calibration.ece(bins)],
        {
            "calibration/per_bin_details": lambda: calibration.bin_table(bins),
            "calibration/per_category_ece": by_category,
        },
    )


def _cover(ctx: Evaluation) -> GroupResult:
    table = pin(cover.cover_by_class(ctx.counted(), ctx.classes))
    return GroupResult([cover.cover_scalars(table)], {"cover/per_class_cover_metrics": lambda: table})


def _per_source(ctx: Evaluation) -> GroupResult:
    scores = pin(per_source.source_scores(ctx.counted(), ctx.classes))
    span = per_source.source_range(scores)
    named = span.select(*[F.col(c).cast("double").alias(f"per_source/{c}") for c in span.columns])
    return GroupResult([named], {"per_source/metrics": lambda: per_source.per_source(scores)})


def _probability(ctx: Evaluation) -> GroupResult:
    return GroupResult(
        [probability.log_loss(ctx.probs)],
        {"probability/per_category_log_loss": lambda: probability.category_log_loss(ctx.probs, ctx.classes)},
    )


def _ranking(ctx: Evaluation) -> GroupResult:
    ranks = ranking.with_rank(ctx.probs)
    hier = pin(ranking.hierarchical_topk(ranking.best_similarity(ctx.probs, ctx.classes)))
    five = hier.where(F.col("k") == 5).select(
        F.col("mean_max_similarity").alias("hierarchical_top_5_mean_similarity")
    )
    return GroupResult(
        [ranking.topk_scalars(ranks), five],
        {
            "ranking/per_category_topk": lambda: ranking.category_topk(ranks, ctx.classes),
            "ranking/hierarchical_topk": lambda: hier,
        },
    )


@dataclass(frozen=True)
class MetricGroup:
    name: str
    run: Callable[[Evaluation], GroupResult]
    needs_sources: bool = False
    needs_probs: bool = False


GROUPS = (
    MetricGroup("confusion_matrices", _confusion),
    MetricGroup("precision_recall_f1", _precision_recall),
    MetricGroup("balanced_accuracy_mcc", _balanced),
    MetricGroup("taxonomic", _taxonomic),
    MetricGroup("calibration", _calibration),
    MetricGroup("cover", _cover, needs_sources=True),
    MetricGroup("per_source", _per_source, needs_sources=True),
    MetricGroup("probability", _probability, needs_probs=True),
    MetricGroup("ranking", _ranking, needs_probs=True),
)


def applicable(ctx: Evaluation, groups: Sequence[MetricGroup] = GROUPS) -> list[MetricGroup]:
    return [
        g
        for g in groups
        if not (g.needs_sources and not ctx.has_sources) and not (g.needs_probs and ctx.probs is None)
    ]


def long_scalars(one_row: DataFrame) -> DataFrame:
    """(name, value) of a one-row table; NaN and NULL are left out."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in one_row.columns]
    )
    return one_row.select(F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))


@dataclass
class Metrics:
    """Scalars (name, value), the named tables, and why each failed group failed. No scalars: invalid input."""

    scalars: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)


def evaluate(ctx: Evaluation, groups: Sequence[MetricGroup] = GROUPS, tables: bool = True) -> Metrics:
    """All groups whose inputs exist; without ``tables``, their scalars only.

    A group's scalars and tables (of class, category or source size) are written within its guard, so a failure belongs to its group and
    leaves nothing behind that fails later. ``AT_ONCE`` groups run side by side; the results come in the order of the groups.
    """
    out = Metrics()
    try:
        ctx.validate()
    except InvalidEvaluation as error:
        logger.warning("Metrics skipped: invalid evaluation", exc_info=True)
        out.failed["evaluation"] = str(error)
        return out

    def run(group: MetricGroup) -> tuple[DataFrame | None, dict[str, DataFrame]] | Exception:
        try:
            result = group.run(ctx)
            rows = None
            for one in result.scalars:
                rows = long_scalars(one) if rows is None else rows.unionByName(long_scalars(one))
            rows = pin(rows) if rows is not None else None
            wanted = result.tables if tables else {}
            return rows, {name: _written(t() if callable(t) else t) for name, t in wanted.items()}
        except Exception as error:
            logger.warning("Metric group '%s' failed", group.name, exc_info=True)
            return error

    chosen = applicable(ctx, groups)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        results = list(pool.map(run, chosen))
    for group, result in zip(chosen, results):
        if isinstance(result, Exception):
            out.failed[group.name] = str(result)
            continue
        rows, made = result
        if rows is not None:
            out.scalars = rows if out.scalars is None else out.scalars.unionByName(rows)
        out.tables.update(made)
    return out


def _written(table: DataFrame) -> DataFrame:
    """A report table in its order, written as one sorted file."""
    return pin(table.coalesce(1))


def evaluate_head(
    points: DataFrame,
    features: DataFrame,
    head: scoring.Head,
    classes: DataFrame,
    walked: DataFrame,
    groups: Sequence[MetricGroup] = GROUPS,
    tables: bool = True,
) -> Metrics:
    """From validation points and feature vectors to all metric groups.

    ``points`` has the feature key (bucket, feature_vector, row, col), ``gt`` and the image's site, project_id and image_id;
    ``features`` the key and ``features``. The scored rows are written once, as every group reads them.
    """
    key = ["bucket", "feature_vector", "row", "col"]
    require_one_vector(features)
    joined = join_features(points, features)
    scoring.warn_on_drift(scored := stage(scoring.score(joined, head), "scored"))
    require_known_labels(scored, classes)
    predictions = scoring.top_label(scored, classes).select(
        *key,
        F.concat_ws("/", "site", "project_id", "image_id").alias("image_key"),
        source_key("site", "project_id").alias("source_key"),
        "gt",
        "est",
        "score",
    )
    probs = encode_labels(scored, classes).select(*key, "gt_idx", "proba")
    return evaluate(Evaluation(predictions, classes, walked, key, probs), groups, tables)
