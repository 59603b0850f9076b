"""Rounding, confidence bands and probability-array arithmetic, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability floors of the two log losses, confidence bands in percent.
LIBRARY_EPS = 2.220446049250313e-16
CATEGORY_EPS = 1e-15
BAND_HIGH = 70
BAND_MEDIUM = 50


def half_even(value: Column, places: int = 3) -> Column:
    """Round half to even, as reports do."""
    return F.bround(value, places)


def score_percent(score: Column) -> Column:
    return F.bround(score * 100, 0).cast("int")


def confidence_band(score: Column) -> Column:
    percent = score_percent(score)
    return (
        F.when(percent >= BAND_HIGH, "high").when(percent >= BAND_MEDIUM, "medium").otherwise("low")
    )


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a lambda would repeat it per element)."""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    def shifted(top: Column) -> Column:
        powers = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
        return let(powers, normalised)

    return let(F.array_max(logits).cast("double"), shifted)


def normalised(values: Column) -> Column:
    """Divide by the total; a total of zero gives the uniform row."""
    uniform = F.lit(1.0) / F.size(values)
    return let(
        array_total(values),
        lambda total: F.transform(values, lambda x: F.when(total == 0, uniform).otherwise(F.try_divide(x, total))),
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return array_total(products)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(eps))


def max_abs_difference(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.array_max(gaps)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def true_rank(proba: Column, gt: Column) -> Column:
    """1-based rank of class ``gt``; equal probabilities rank by class index."""
    p_true = F.get(proba, gt)
    indexed = F.transform(proba, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    ahead = F.filter(
        indexed, lambda e: (e["p"] > p_true) | ((e["p"] == p_true) & (e["i"] < gt))
    )
    return F.size(ahead) + 1


def top_classes(proba: Column, k: int) -> Column:
    """Indexes of the ``k`` most probable classes, ties by class index."""
    indexed = F.transform(proba, lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(indexed), 1, k), lambda e: e["i"])
