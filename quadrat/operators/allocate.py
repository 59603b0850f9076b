"""Per-class row budgets. Input and output are class tables: one row per class, never raw rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.prepare import CLASS


@dataclass(frozen=True)
class SubsampleOptions:
    """How many rows to keep in all, dealt to the classes by the allocator ``strategy``.

    No class is cut below ``min_per_class`` rows, even where that exceeds the total.
    """

    strategy: str = "stratified"
    total_annotations: int | None = None
    min_per_class: int = 0

    def __post_init__(self) -> None:
        problems = []
        if self.strategy not in ALLOCATORS:
            problems.append(f"no allocator is called {self.strategy!r} (there are {', '.join(ALLOCATORS)})")
        if not self.total_annotations or self.total_annotations < 0:
            problems.append(f"total_annotations is {self.total_annotations}, and has to be positive")
        if self.min_per_class < 0:
            problems.append(f"min_per_class is {self.min_per_class}, below zero")
        if problems:
            raise ValueError("Subsampling: " + "; ".join(problems))


def _over_all(column: Column) -> Column:
    # One task, over class rows only.
    return column.over(Window.partitionBy(F.lit(0)))


def _half_even_share(total: int, n: Column, every: Column) -> Column:
    """total * n / every, rounded half to even; the product may be beyond bigint, so it is a decimal."""
    wide = F.lit(total).cast("decimal(19,0)") * n.cast("decimal(19,0)")
    every = every.cast("decimal(19,0)")
    rest = wide % every
    whole = ((wide - rest) / every).cast("decimal(38,0)")
    up = (rest * 2 > every) | ((rest * 2 == every) & (whole % 2 == 1))
    return (whole + up.cast("int")).cast("long")


def trim_overshoot(targets: DataFrame, total: int, floor: int) -> DataFrame:
    """Take the excess over ``total`` from the largest classes first, never below ``floor``."""
    largest_first = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.desc("n"), *CLASS)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    room = F.greatest(F.col("target_n") - floor, F.lit(0))
    cut = (
        targets.withColumn("_room", room)
        .withColumn("_over", _over_all(F.sum("target_n")) - total)
        .withColumn("_upto", F.sum("_room").over(largest_first))
    )
    already = F.col("_upto") - F.col("_room")
    take = F.least(F.col("_room"), F.greatest(F.lit(0), F.col("_over") - already))
    return cut.select(*CLASS, "n", (F.col("target_n") - take).cast("long").alias("target_n"))


def stratified(options: SubsampleOptions, counts: DataFrame) -> DataFrame:
    """Proportional budgets: round half even of total * n / N, within [floor, n], then trimmed."""
    share = _half_even_share(options.total_annotations, F.col("n"), _over_all(F.sum("n")))
    bounded = F.greatest(F.lit(options.min_per_class), F.least(F.col("n"), share))
    targets = counts.select(*CLASS, "n", bounded.cast("long").alias("target_n"))
    return trim_overshoot(targets, options.total_annotations, options.min_per_class)


def balanced(options: SubsampleOptions, counts: DataFrame) -> DataFrame:
    """Equal budgets: total div number of classes, within [floor, n]."""
    share = F.floor(F.lit(options.total_annotations) / _over_all(F.count(F.lit(1))))
    bounded = F.greatest(F.lit(options.min_per_class), F.least(F.col("n"), share))
    return counts.select(*CLASS, "n", bounded.cast("long").alias("target_n"))


ALLOCATORS: dict[str, Callable[[SubsampleOptions, DataFrame], DataFrame]] = {
    "stratified": stratified,
    "balanced": balanced,
}


def class_targets(options: SubsampleOptions, counts: DataFrame) -> DataFrame:
    """(attribute_id, form_id, n, target_n) by the options' strategy."""
    return ALLOCATORS[options.strategy](options, counts)
