"""Class-weighted training of a linear head on a feature table with Spark's own estimator."""

from __future__ import annotations

import logging

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.evaluation.probability import check_weights, encode_labels, require_known_labels

logger = logging.getLogger(__name__)


def weighted_rows(points: DataFrame, classes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Labelled points with ``gt_idx`` and ``weight``, the weight of the class (1 without a table of weights).

    A label that is NULL or not in the class list stops the training, as does a class without a weight.
    """
    require_known_labels(points, classes)
    rows = encode_labels(points, classes)
    if weights is None:
        return rows.withColumn("weight", F.lit(1.0))
    check_weights(classes, weights)
    return rows.join(weights.select(F.col("class_id").alias("gt"), "weight"), "gt")


def training_rows(points: DataFrame, classes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(features vector, label index, weight) from labelled points with ``features`` and ``gt``."""
    rows = weighted_rows(points, classes, weights).withColumn("label", F.col("gt_idx").cast("double"))
    return rows.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))


def train_head(
    points: DataFrame,
    classes: DataFrame,
    weights: DataFrame | None = None,
    max_iter: int = 50,
    l2: float = 1e-4,
) -> LogisticRegressionModel:
    """Multinomial logistic regression, the loss weighted by class.

    A model that used up its steps is returned with a warning: its loss had not settled.
    """
    estimator = LogisticRegression(
        family="multinomial", maxIter=max_iter, regParam=l2, weightCol="weight"
    )
    model = estimator.fit(training_rows(points, classes, weights))
    if model.summary.totalIterations >= max_iter:
        logger.warning("The head had not settled after %d steps; raise max_iter.", max_iter)
    return model


def predict(model: LogisticRegressionModel, points: DataFrame) -> DataFrame:
    """Add ``proba`` to rows with an array column ``features``."""
    kept = [F.col(c) for c in points.columns if c != "features"]
    vectors = points.withColumn("_v", array_to_vector(F.col("features").cast("array<double>")))
    scored = model.setFeaturesCol("_v").transform(vectors)
    return scored.select(*kept, vector_to_array("probability").alias("proba"))
