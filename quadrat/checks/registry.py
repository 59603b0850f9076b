"""All registered queries: name to (Spark function, SQL text or None)."""

from quadrat.checks import dataset, evaluation, models

QUERIES = {**dataset.QUERIES, **evaluation.QUERIES, **models.QUERIES}
