"""Queries on scoring, parity, drift, calibration, training and the file formats around them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from pyspark.ml.functions import vector_to_array

from quadrat.checks.bindings import (
    NODES,
    PREDS,
    PROBS,
    form_names,
    nation_walk,
    nodes,
    prob_classes,
    probs,
    q,
    raw_annotations,
    raw_images,
    table,
    text,
    tidy,
)
from quadrat.checks.evaluation import SCALARS
from quadrat.functions.keys import class_key, provider_feature_path
from quadrat.operators import calibrate, epochs, features, runs, scoring, train
from quadrat.operators.staging import staging_root
from quadrat.operators.taxonomy import class_list, class_table
from quadrat.operators.weights import class_weights
from quadrat.plans.evaluate import evaluate_head
from quadrat.sources import exports, sinks, source_files, tables

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def _checksum(column: str):
    """Sum of all values of a vector, each times its position."""
    weighed = F.transform(column, lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(weighed, F.lit(0.0), lambda total, x: total + x).alias("checksum")


def _path(spark, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- scoring ------------------------------------------------------------------------------------

INPUTS, HIDDEN, CLASSES = 64, 8, 10


def head() -> scoring.Head:
    """A two-layer head whose parameters follow a rule, so that SQL can state them too."""
    h, j, k = np.arange(HIDDEN), np.arange(INPUTS), np.arange(CLASSES)
    first = ((h[:, None] * 5 + j[None, :] * 3) % 7 - 3) / 10.0
    second = ((k[:, None] * 3 + h[None, :] * 2) % 5 - 2) / 2.0
    return scoring.Head(
        [first, second],
        [(h % 3 - 1) / 10.0, (k % 4 - 1) / 10.0],
        -2.0 - k / 10.0,
        0.5 + k / 20.0,
        [f"n{i}::" for i in k],
    )


HEAD = """x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
hid AS (SELECT vec_id, label, h, greatest(0.0, sum(v * (((h * 5 + j * 3) % 7 - 3) / 10.0)) + (h % 3 - 1) / 10.0) AS a
  FROM x, range(8) r(h) GROUP BY 1, 2, 3),
lg AS (SELECT vec_id, label, k, sum(a * (((k * 3 + h * 2) % 5 - 2) / 2.0)) + (k % 4 - 1) / 10.0 AS z
  FROM hid, range(10) r(k) GROUP BY 1, 2, 3),
ex AS (SELECT vec_id, label, k, exp(z - max(z) OVER (PARTITION BY vec_id)) AS u FROM lg),
soft AS (SELECT vec_id, label, k, u / sum(u) OVER (PARTITION BY vec_id) AS p FROM ex),
cal AS (SELECT vec_id, label, k, 1 / (1 + exp((-2 - k / 10.0) * p + 0.5 + k / 20.0)) AS c FROM soft),
scored AS (SELECT vec_id, label, CAST(k AS INTEGER) AS k, c / sum(c) OVER (PARTITION BY vec_id) AS p FROM cal)"""


def _scored(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumnRenamed("embedding", "features")
    model = head()
    return scoring.score(vectors, model)


@query("head_scores", f"WITH {HEAD} SELECT vec_id, k, {q('p')} AS p FROM scored")
def _(spark, sf):
    return tidy(_scored(spark, sf).select("vec_id", F.posexplode("proba").alias("k", "p")))


@query(
    "head_input_check",
    """SELECT CAST(min(len(embedding)) AS INTEGER) AS dimension, count(*) AS vectors FROM embeddings""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumnRenamed("embedding", "features")
    scoring.require_dimension(vectors, head())
    dimension = tables.check_one_dimension(vectors)
    return vectors.agg(F.lit(dimension).alias("dimension"), F.count(F.lit(1)).alias("vectors"))


@query(
    "head_top_label",
    f"""WITH {HEAD} SELECT vec_id, 'n' || arg_max(k, (p, -k)) || '::' AS est, {q('max(p)')} AS score
        FROM scored GROUP BY vec_id""",
)
def _(spark, sf):
    top = scoring.top_label(_scored(spark, sf), prob_classes(spark, sf))
    return tidy(top.select("vec_id", "est", "score"))


TOP3 = f"""{PROBS}, top3 AS (SELECT vec_id, gt, k, p,
  row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS r FROM probs QUALIFY r <= 3)"""


@query(
    "top_labels",
    f"""WITH {TOP3} SELECT vec_id, gt AS gt_idx, CAST(r AS INTEGER) AS "rank", 'n' || k || '::' AS label, {q('p')} AS score FROM top3""",
)
def _(spark, sf):
    return tidy(scoring.top_labels(probs(spark, sf), prob_classes(spark, sf), 3))


@query(
    "wide_predictions",
    f"""WITH {TOP3} SELECT CAST(vec_id AS INTEGER) AS "row", CAST(gt AS INTEGER) AS "column",
        max(CASE r WHEN 1 THEN 'n' || k || '::' END) AS label, printf('%.4f', max(CASE r WHEN 1 THEN p END)) AS score,
        max(CASE r WHEN 2 THEN 'n' || k || '::' END) AS label2, printf('%.4f', max(CASE r WHEN 2 THEN p END)) AS score2,
        max(CASE r WHEN 3 THEN 'n' || k || '::' END) AS label3, printf('%.4f', max(CASE r WHEN 3 THEN p END)) AS score3,
        'v' || vec_id AS note FROM top3 GROUP BY vec_id, gt""",
)
def _(spark, sf):
    path = _path(spark, "points")
    given = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row"),
        F.col("label").alias("column"),
        F.lit("old").alias("label"),
        F.concat(F.lit("v"), "vec_id").alias("note"),
    )
    sinks.write_csv(given, path)
    listed = spark.read.csv(path, header=True, schema="row int, column int, label string, note string")
    listed = listed.withColumn("_order", F.monotonically_increasing_id())
    ranked = scoring.top_labels(probs(spark, sf), prob_classes(spark, sf), 3).select(
        F.col("vec_id").cast("int").alias("row"), F.col("gt_idx").alias("column"), "rank", "label", "score"
    )
    return sinks.wide_predictions(listed, ranked, 3, "_order")


@query(
    "row_sum_drift",
    f"""WITH {PROBS}, s AS (SELECT vec_id, sum(p * (1 + vec_id / 1e6)) AS t FROM probs GROUP BY 1)
        SELECT {q('max(abs(t - 1))')} AS max_drift, max(abs(t - 1)) > 1e-4 AS suspicious FROM s""",
)
def _(spark, sf):
    return tidy(scoring.row_sum_drift(_stretched(spark, sf)))


def _stretched(spark, sf):
    factor = F.lit(1.0) + F.col("vec_id") / 1e6
    return probs(spark, sf).withColumn("proba", F.transform("proba", lambda p: p * factor))


@query("probabilities_renormalised", f"WITH {PROBS} SELECT vec_id, CAST(k AS INTEGER) AS k, {q('p')} AS p FROM probs")
def _(spark, sf):
    fixed = scoring.renormalised(_stretched(spark, sf))
    return tidy(fixed.select("vec_id", F.posexplode("proba").alias("k", "p")))


@query(
    "prediction_parity",
    f"""WITH {PROBS} SELECT count(DISTINCT vec_id) AS n, round(max(abs(p - round(p, 5))), 8) + 0.0 AS max_abs_diff,
        max(abs(p - round(p, 5))) <= 1e-6 AS passed FROM probs""",
)
def _(spark, sf):
    given = probs(spark, sf)
    other = given.withColumn("proba", F.transform("proba", lambda p: F.round(p, 5)))
    return tidy(scoring.parity(given, other, ["vec_id"]), 8)


DRIFT = """r AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings),
b AS (SELECT vec_id, a, round(a, 2) AS b FROM r),
d AS (SELECT vec_id, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12) AS cosine,
  max(abs(a - b)) AS max_abs_diff FROM b GROUP BY vec_id)"""


def _drift(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    b = a.withColumn("features", F.transform("features", lambda x: F.round(x.cast("double"), 2)))
    return features.drift_rows(a, b, ["vec_id"])


@query(
    "feature_drift",
    f"WITH {DRIFT} SELECT vec_id, {q('cosine')} AS cosine, {q('max_abs_diff')} AS max_abs_diff FROM d",
)
def _(spark, sf):
    return tidy(_drift(spark, sf))


@query(
    "feature_drift_summary",
    f"""WITH {DRIFT} SELECT count(*) AS n, {q('min(cosine)')} AS min_cosine, {q('median(cosine)')} AS median_cosine,
        {q('max(max_abs_diff)')} AS max_abs_diff, min(cosine) >= 0.999 AS passed FROM d""",
)
def _(spark, sf):
    return tidy(features.drift_summary(_drift(spark, sf)))


@query(
    "points_with_features",
    """SELECT 'features' AS bucket, 's' || label || '/features/i' || (vec_id // 10) || '.featurevector' AS feature_vector,
       vec_id AS "row", label AS col, CAST(len(embedding) AS INTEGER) AS dims,
       (SELECT round(sum(CAST(v AS DOUBLE) * j), 5) + 0.0 FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j) u)
       AS checksum FROM embeddings""",
)
def _(spark, sf):
    base = table(spark, sf, "embeddings").select(
        F.lit("features").alias("bucket"),
        provider_feature_path(F.col("label"), F.floor(F.col("vec_id") / 10)).alias("feature_vector"),
        F.col("vec_id").alias("row"),
        F.col("label").alias("col"),
        "embedding",
    )
    points = base.drop("embedding")
    joined = features.join_features(points, features.store_features(base.withColumnRenamed("embedding", "features")))
    return tidy(
        joined.select(
            "bucket",
            "feature_vector",
            "row",
            "col",
            F.size("features").alias("dims"),
            _checksum("features"),
        ),
        5,
    )


@query(
    "features_flattened",
    """SELECT vec_id // 10 AS image_id, vec_id AS "row", label AS col,
       (SELECT round(sum(CAST(v AS DOUBLE) * j), 5) + 0.0 FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j) u)
       AS checksum FROM embeddings""",
)
def _(spark, sf):
    # Ten vectors per record, as an image file holds the points of one image.
    records = (
        table(spark, sf, "embeddings")
        .groupBy(F.floor(F.col("vec_id") / 10).alias("image_id"))
        .agg(
            F.collect_list(
                F.struct(F.col("vec_id").alias("row"), F.col("label").alias("col"), F.col("embedding").alias("data"))
            ).alias("point_features")
        )
    )
    flat = tables.flatten_features(records)
    tables.check_one_dimension(flat)
    return tidy(
        flat.select("image_id", "row", "col", _checksum("features")), 5
    )


# --- fitting ------------------------------------------------------------------------------------


def _newton(steps: int, problems: str) -> str:
    """``steps`` Newton steps of all problems (k, f, y), one table expression each, ending in ``fitted(k, a, b)``."""
    text = f"""{problems}, sizes AS (SELECT k, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM long GROUP BY k),
s0 AS MATERIALIZED (SELECT k, CAST(0 AS DOUBLE) AS a, ln((neg + 1.0) / (pos + 1.0)) AS b FROM sizes)"""
    for i in range(steps):
        text += f""",
g{i} AS MATERIALIZED (SELECT k, a, b, sum((t - p) * f) AS ga, sum(t - p) AS gb, sum(p * (1 - p) * f * f) + 1e-12 AS haa,
  sum(p * (1 - p) * f) AS hab, sum(p * (1 - p)) + 1e-12 AS hbb
  FROM (SELECT k, f, a, b, CASE WHEN y THEN (pos + 1.0) / (pos + 2.0) ELSE 1.0 / (neg + 2.0) END AS t,
          1 / (1 + exp(a * f + b)) AS p FROM long JOIN s{i} USING (k) JOIN sizes USING (k)) u GROUP BY k, a, b),
s{i + 1} AS MATERIALIZED (SELECT k, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
  b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{i})"""
    return text + f", fitted AS (SELECT k, a, b FROM s{steps})"


LONG = f"{PROBS}, long AS MATERIALIZED (SELECT vec_id, CAST(k AS INTEGER) AS k, p AS f, gt = k AS y FROM probs)"
# Two classes: even and odd ones; the one problem is that of class 1.
PAIRS = f"""{PROBS}, two AS (SELECT vec_id, gt % 2 AS gt, sum(p) FILTER (WHERE k % 2 = 1) AS f FROM probs GROUP BY 1, 2),
long AS MATERIALIZED (SELECT vec_id, CAST(1 AS INTEGER) AS k, f, gt = 1 AS y FROM two)"""


def _pairs(spark, sf):
    def half(odd: int):
        own = F.filter("proba", lambda _, k: k % 2 == odd)
        return F.aggregate(own, F.lit(0.0), lambda total, p: total + p)

    return probs(spark, sf).select("vec_id", (F.col("gt_idx") % 2).alias("gt_idx"), F.array(half(0), half(1)).alias("proba"))


@query(
    "sigmoid_calibration",
    f"WITH {_newton(12, LONG)} SELECT k, {q('a', 5)} AS a, {q('b', 5)} AS b, true AS converged FROM fitted",
)
def _(spark, sf):
    return tidy(calibrate.fit_sigmoids(probs(spark, sf), CLASSES).drop("steps"), 5)


@query(
    "two_class_calibration",
    f"WITH {_newton(12, PAIRS)} SELECT k, {q('a', 5)} AS a, {q('b', 5)} AS b, true AS converged FROM fitted",
)
def _(spark, sf):
    return tidy(calibrate.fit_sigmoids(_pairs(spark, sf), 2).drop("steps"), 5)


@query(
    "calibrated_probabilities",
    f"""WITH {_newton(12, LONG)}, raw AS (SELECT vec_id, k, 1 / (1 + exp(a * f + b)) AS c FROM long JOIN fitted USING (k))
        SELECT vec_id, k, {q('c / sum(c) OVER (PARTITION BY vec_id)')} AS p FROM raw""",
)
def _(spark, sf):
    rows = probs(spark, sf)
    fixed = calibrate.apply_sigmoids(rows, calibrate.fit_sigmoids(rows, CLASSES))
    return tidy(fixed.select("vec_id", F.posexplode("proba").alias("k", "p")))


@query(
    "two_class_probabilities",
    f"""WITH {_newton(12, PAIRS)} SELECT vec_id, {q('1 - 1 / (1 + exp(a * f + b))')} AS p0, {q('1 / (1 + exp(a * f + b))')} AS p1
        FROM long JOIN fitted USING (k)""",
)
def _(spark, sf):
    rows = _pairs(spark, sf)
    fixed = calibrate.apply_sigmoids(rows, calibrate.fit_sigmoids(rows, 2))
    return tidy(fixed.select("vec_id", F.col("proba")[0].alias("p0"), F.col("proba")[1].alias("p1")))


@query(
    "training_rows",
    f"""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
        SELECT vec_id, CAST(label AS DOUBLE) AS label, {q('1.0 / greatest((1.0 - pow(0.9999, CAST(n AS DOUBLE))) / (1.0 - 0.9999), 1e-12)')} AS weight,
          CAST(len(embedding) AS INTEGER) AS dims,
          (SELECT round(sum(CAST(v AS DOUBLE) * j), 6) + 0.0 FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j) u)
          AS checksum FROM embeddings JOIN n USING (label)""",
)
def _(spark, sf):
    points, classes, weights = _labelled(spark, sf)
    rows = train.training_rows(points, classes, weights).withColumn("features", vector_to_array("features"))
    return tidy(rows.select("vec_id", "label", "weight", F.size("features").alias("dims"), _checksum("features")))


def _labelled(spark, sf):
    classes = prob_classes(spark, sf)
    points = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("features"), class_key(F.concat(F.lit("n"), "label"), F.lit("")).alias("gt")
    )
    counts = points.groupBy(F.col("gt").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return points, classes, class_weights(counts).select("class_id", "weight")


@query("weighted_training", None)
def _(spark, sf):
    points, classes, weights = _labelled(spark, sf)
    model = train.train_head(points, classes, weights)
    return scoring.top_label(train.predict(model, points), classes).select("vec_id", "gt", "est", "score")


# The first hexadecimal digit of the key's MD5 deals vectors to the three sets. A linear head starts at zero and takes one step of
# plain descent over all training vectors in each epoch, which SQL can spell out.
EPOCHS, RATE, PENALTY = 3, 0.5, 0.05


def _epoch_sql() -> str:
    parts = [
        """t AS (SELECT vec_id, label, CASE WHEN substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) IN ('0', '1') THEN 'val'
          WHEN substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) IN ('2', '3') THEN 'ref' ELSE 'train' END AS part, embedding FROM embeddings)""",
        """x AS (SELECT vec_id, label, part, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM t
          UNION ALL SELECT vec_id, label, part, -1, 1.0 FROM t)""",
        """cw AS (SELECT label, 1.0 / greatest((1.0 - pow(0.9999, CAST(count(*) AS DOUBLE))) / (1.0 - 0.9999), 1e-12) AS weight
          FROM embeddings GROUP BY 1)""",
        """mass AS (SELECT count(*) AS n, sum(weight) AS total FROM t JOIN cw USING (label) WHERE part = 'train')""",
        "w0 AS (SELECT k, j, 0.0 AS w FROM (SELECT DISTINCT label AS k FROM t), (SELECT DISTINCT j FROM x))",
    ]
    for e in range(EPOCHS + 1):
        parts += [
            f"""z{e} AS (SELECT vec_id, label, part, k, sum(v * w) AS z FROM x JOIN w{e} USING (j) GROUP BY 1, 2, 3, 4)""",
            f"""p{e} AS (SELECT *, z - m - ln(sum(exp(z - m)) OVER (PARTITION BY vec_id)) AS lp
              FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z{e}))""",
            f"""g{e} AS (SELECT k, j, sum(weight * (exp(lp) - CASE WHEN k = label THEN 1.0 ELSE 0.0 END) * v) AS g
              FROM p{e} JOIN x USING (vec_id, label, part) JOIN cw USING (label) WHERE part = 'train' GROUP BY 1, 2)""",
            f"""w{e + 1} AS (SELECT k, j, w - {RATE} * (g / total + CASE WHEN j < 0 THEN 0.0 ELSE {PENALTY} / n * w END) AS w
              FROM w{e} JOIN g{e} USING (k, j) CROSS JOIN mass)""",
            f"""l{e} AS (SELECT sum(CASE WHEN k = label THEN -lp * weight END) / any_value(total)
              + {PENALTY} / 2 / any_value(n) * (SELECT sum(w * w) FROM w{e} WHERE j >= 0) AS loss
              FROM p{e} JOIN cw USING (label) CROSS JOIN mass WHERE part = 'train')""",
            f"""h{e} AS (SELECT part, avg(CASE WHEN best = label THEN 1.0 ELSE 0.0 END) AS accuracy, avg(-own) AS loss FROM
              (SELECT vec_id, part, label, arg_max(k, (lp, -k)) AS best, max(CASE WHEN k = label THEN lp END) AS own
               FROM p{e} WHERE part <> 'train' GROUP BY 1, 2, 3) GROUP BY 1)""",
        ]
    lines = [
        f"""SELECT {e} AS epoch, (SELECT {q('accuracy')} FROM h{e + 1} WHERE part = 'ref') AS ref_accuracy,
          (SELECT {q('accuracy')} FROM h{e + 1} WHERE part = 'val') AS val_accuracy,
          (SELECT {q('loss')} FROM h{e + 1} WHERE part = 'val') AS val_loss, (SELECT {q('loss')} FROM l{e}) AS training_loss"""
        for e in range(EPOCHS)
    ]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(lines)}"


@query("training_epochs", _epoch_sql())
def _(spark, sf):
    points, classes, weights = _labelled(spark, sf)
    digit = F.substring(F.md5(text("vec_id")), 1, 1)
    part = F.when(digit.isin("0", "1"), "val").when(digit.isin("2", "3"), "ref").otherwise("train")
    sets = [points.where(part == name) for name in ("train", "ref", "val")]
    options = epochs.EpochOptions(hidden=(), epochs=EPOCHS, batch_rows=2**40, rate=RATE, l2=PENALTY, method="sgd", patience=2)
    log = epochs.train_epochs(*sets, classes, ["vec_id"], weights, options).log
    return tidy(log.drop("run_id", "cumulative_seconds"))


# --- from features to metrics ---------------------------------------------------------------------

# The same head over five nations with two forms each: class k is nation k div 2 with form A or R.
FORMS = ["A", "R"]
HEAD_PREDS = f"""{HEAD}, top AS (SELECT vec_id, label, arg_max(k, (p, -k)) AS e, max(p) AS score FROM scored GROUP BY 1, 2),
coded AS (SELECT *, 'n' || (label // 2) AS gt_attr, CASE label % 2 WHEN 0 THEN 'A' ELSE 'R' END AS gt_form,
  'n' || (e // 2) AS est_attr, CASE e % 2 WHEN 0 THEN 'A' ELSE 'R' END AS est_form FROM top),
preds AS (SELECT vec_id AS l_orderkey, 0 AS l_partkey, 0 AS l_suppkey, 0 AS l_linenumber, 0 AS l_quantity,
  'provider/' || (label % 3) || '/' || (vec_id // 10) AS image_key, 'provider:' || (label % 3) AS source_key,
  gt_attr, gt_form, est_attr, est_form, gt_attr || '::' || gt_form AS gt, est_attr || '::' || est_form AS est, score FROM coded)"""
HEAD_SCALARS = (
    SCALARS.replace(PREDS, HEAD_PREDS)
    .replace("CROSS JOIN forms)", "CROSS JOIN forms WHERE form_id <> '' AND n_nationkey < 5)")
    .removesuffix(")")
    + f"""
  UNION ALL SELECT 'log_loss', avg(-ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))
    FROM scored WHERE k = label
  UNION ALL SELECT * FROM ranked_scalars)"""
).replace("scalars AS (", """ranks AS (SELECT t.vec_id, 1 + count(*) FILTER (WHERE o.p > t.p OR (o.p = t.p AND o.k < t.k)) AS "rank"
  FROM scored t JOIN scored o USING (vec_id) WHERE t.k = t.label GROUP BY 1),
five AS (SELECT vec_id, label, k FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) <= 5),
alike AS (SELECT vec_id, max(CASE WHEN label // 2 = k // 2 THEN 1.0 WHEN a.n_regionkey = b.n_regionkey THEN 0.5 ELSE 0.0 END) AS s
  FROM five JOIN nation a ON a.n_nationkey = label // 2 JOIN nation b ON b.n_nationkey = k // 2 GROUP BY 1),
ranked_scalars AS (
  SELECT 'top_1_accuracy' AS name, avg(CASE WHEN "rank" <= 1 THEN 1.0 ELSE 0.0 END) AS value FROM ranks
  UNION ALL SELECT 'top_3_accuracy', avg(CASE WHEN "rank" <= 3 THEN 1.0 ELSE 0.0 END) FROM ranks
  UNION ALL SELECT 'top_5_accuracy', avg(CASE WHEN "rank" <= 5 THEN 1.0 ELSE 0.0 END) FROM ranks
  UNION ALL SELECT 'top_10_accuracy', avg(CASE WHEN "rank" <= 10 THEN 1.0 ELSE 0.0 END) FROM ranks
  UNION ALL SELECT 'mrr', avg(1.0 / CAST("rank" AS DOUBLE)) FROM ranks
  UNION ALL SELECT 'hierarchical_top_5_mean_similarity', avg(s) FROM alike),
scalars AS (""", 1)


def head_metrics(spark, sf):
    """Feature vectors joined to validation points, scored, labelled and put through all metric groups."""
    embeddings = table(spark, sf, "embeddings")
    form = F.when(F.col("label") % 2 == 0, "A").otherwise("R")
    base = embeddings.select(
        F.lit("features").alias("bucket"),
        provider_feature_path(F.col("label"), F.floor(F.col("vec_id") / 10)).alias("feature_vector"),
        F.col("vec_id").alias("row"),
        F.col("label").alias("col"),
        class_key(F.concat(F.lit("n"), F.floor(F.col("label") / 2)), form).alias("gt"),
        F.lit("provider").alias("site"),
        text(F.col("label") % 3).alias("project_id"),
        text(F.floor(F.col("vec_id") / 10)).alias("image_id"),
        F.col("embedding").alias("features"),
    )
    keys = spark.createDataFrame([(f"n{k // 2}::{FORMS[k % 2]}",) for k in range(CLASSES)], "class_id string")
    walked = nation_walk(spark, sf)
    classes = class_table(class_list(keys), walked, form_names(spark))
    key = ["bucket", "feature_vector", "row", "col"]
    return evaluate_head(base.drop("features"), base.select(*key, "features"), head(), classes, walked, tables=False)


@query("head_metrics", f"WITH {HEAD_SCALARS} SELECT name, {q('value')} AS value FROM scalars")
def _(spark, sf):
    return tidy(head_metrics(spark, sf).scalars)


# The names and their order as a report needs them, written out here so that the list itself is compared.
_HEADLINE = """(0, 'executive', 'accuracy'), (1, 'executive', 'balanced_accuracy'), (2, 'executive', 'f1_macro'),
  (3, 'executive', 'precision_macro'), (4, 'executive', 'recall_macro'), (5, 'executive', 'mcc'), (6, 'executive', 'ece'),
  (7, 'executive', 'log_loss'), (8, 'topk', 'top_1_accuracy'), (9, 'topk', 'top_3_accuracy'), (10, 'topk', 'top_5_accuracy'),
  (11, 'topk', 'top_10_accuracy'), (12, 'topk', 'mrr'), (13, 'topk', 'hierarchical_top_5_mean_similarity'),
  (14, 'cover', 'cover_mean_abs_bias_pct'), (15, 'cover', 'cover_mean_rmse_pct'), (16, 'cover', 'cover_mean_mae_pct'),
  (17, 'cover', 'cover_median_r_squared'), (18, 'taxonomic', 'cross_branch_error_rate'),
  (19, 'taxonomic', 'within_branch_error_rate'), (20, 'taxonomic', 'gf_accuracy_gf_relevant'), (21, 'taxonomic', 'within_ba_gf_accuracy')"""


@query(
    "headline_metrics",
    f"""WITH {HEAD_SCALARS}, spec AS (SELECT * FROM (VALUES {_HEADLINE}) AS h(position, section, name))
        SELECT position, section, name, {q('value')} AS value FROM spec JOIN scalars USING (name)""",
)
def _(spark, sf):
    return tidy(runs.headline(head_metrics(spark, sf).scalars).drop("label"))


# --- files --------------------------------------------------------------------------------------


@query("taxonomy_export", f"WITH {NODES} SELECT id, name, parent FROM nodes")
def _(spark, sf):
    path = _path(spark, "export")
    # Pages of at most 1000 nodes, one JSON document per line.
    paged = nodes(spark, sf).withColumn(
        "page", F.floor(F.coalesce(F.substring("id", 2, 20).cast("long"), F.lit(0)) / 1000)
    )
    paged.groupBy(F.substring("id", 1, 1).alias("kind"), "page").agg(
        F.collect_list(F.struct("id", "name", "parent")).alias("results")
    ).select("results").write.json(path)
    return exports.read_taxonomy(spark, path, multi_line=False)


@query(
    "label_mapping_export",
    """SELECT p_name AS provider_label, lower(p_type) AS attribute_name,
       CASE WHEN p_size <= 20 THEN '' ELSE lower(p_brand) END AS form_name, CAST(p_partkey AS VARCHAR) AS provider_id,
       p_type AS attribute_id, CASE WHEN p_size <= 20 THEN '' ELSE p_brand END AS form_id FROM part""",
)
def _(spark, sf):
    path = _path(spark, "export")
    form = F.when(F.col("p_size") > 20, F.col("p_brand"))
    entries = table(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 1000).alias("page"),
        F.struct(
            text("p_partkey").alias("provider_id"),
            F.col("p_name").alias("provider_label"),
            F.col("p_type").alias("benthic_attribute_id"),
            F.lower("p_type").alias("benthic_attribute_name"),
            form.alias("growth_form_id"),
            F.lower(form).alias("growth_form_name"),
        ).alias("e"),
    )
    entries.groupBy("page").agg(F.collect_list("e").alias("results")).select("results").write.json(path)
    return exports.read_label_mapping(spark, path, multi_line=False)


@query("form_export", "SELECT DISTINCT p_brand AS id, lower(p_brand) AS name FROM part")
def _(spark, sf):
    path = _path(spark, "export")
    forms = table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.lower("p_brand").alias("name")).distinct()
    choices = forms.groupBy(F.lit("growthforms").alias("name"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("_page")).agg(
        F.collect_list(F.struct("id", "name")).alias("data")
    )
    other = choices.select(F.lit("depths").alias("name"), "data")
    choices.select("name", "data").union(other).write.json(path)
    return exports.read_forms(spark, path, multi_line=False)


@query(
    "feature_files_listed",
    "SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS source_id FROM supplier",
)
def _(spark, sf):
    path = _path(spark, "features")
    table(spark, sf, "supplier").repartition("s_nationkey").write.partitionBy("s_nationkey").parquet(path)
    listing = tables.list_feature_files(spark, path, "*.parquet")
    return listing.select(F.regexp_extract("feature_full", r"/s_nationkey=(\d+)/", 1).alias("source_id")).distinct()


@query(
    "label_names_in_use",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part
       WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""",
)
def _(spark, sf):
    path = _path(spark, "csv")
    sinks.write_csv(
        table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_type"), path
    )
    used = table(spark, sf, "lineitem").select(text("l_partkey").alias("label"))
    return exports.read_label_names(spark, path, used)


@query(
    "points_csv",
    """SELECT CAST(l_partkey AS INTEGER) AS "row", l_linenumber AS "column",
       CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS label,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS score FROM lineitem""",
)
def _(spark, sf):
    path = _path(spark, "csv")
    sinks.write_csv(
        table(spark, sf, "lineitem").select(
            F.col("l_partkey").alias("row"),
            F.col("l_linenumber").alias("column"),
            F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("label"),
            F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("score"),
        ),
        path,
    )
    return exports.read_points(spark, path)


ANNOTATED = """rows AS (SELECT CAST(s_nationkey AS VARCHAR) AS source_id, l_orderkey, l_partkey, l_linenumber, o_orderstatus,
  s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey),
resolved AS (SELECT source_id, CASE WHEN s_nationkey < 12 OR o_orderstatus <> 'P' THEN CAST(l_orderkey AS VARCHAR) END AS image_id,
  CAST(l_partkey AS VARCHAR) AS "Row", CAST(l_linenumber AS VARCHAR) AS "Column", CAST(l_partkey AS VARCHAR) AS "Label ID"
  FROM rows)"""


def _source_files(spark, sf):
    """Write annotation files of two layouts (by nation) and image lists, and read them back."""
    root = _path(spark, "sources")
    supplier = table(spark, sf, "supplier")
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("source_id"),
        F.col("l_partkey").alias("Row"),
        F.col("l_linenumber").alias("Column"),
        F.col("l_partkey").alias("Label ID"),
        F.col("l_orderkey").alias("Image ID"),
        F.concat(F.lit("p"), "l_orderkey", F.lit(".JPG")).alias("Name"),
    )
    by_id = rows.where("source_id < 12").drop("Name")
    quoted = by_id.where("source_id < 3").withColumnRenamed("Image ID", "Taken, by").withColumn("Image ID", F.col("Taken, by"))
    by_name = rows.where("source_id >= 12").drop("Image ID")
    sinks.write_annotations_by_source(by_id.where("source_id >= 3"), f"{root}/by_id")
    sinks.write_annotations_by_source(quoted, f"{root}/quoted")  # a header with a quoted name
    sinks.write_annotations_by_source(by_name.where("source_id < 18"), f"{root}/by_name")
    # Writing again changes nothing for the sources that are there, and adds those that are not.
    sinks.write_annotations_by_source(by_name, f"{root}/by_name")
    listed = (
        rows.where("source_id >= 12")
        .select("source_id", F.col("Image ID").alias("o"))
        .distinct()
        .join(orders.where("o_orderstatus <> 'P'"), F.col("o") == F.col("o_orderkey"))
    )
    status = F.when(F.col("o_orderstatus") == "F", " - Confirmed").otherwise(" - Unclassified")
    images = listed.select(
        text("source_id").alias("source_id"),
        F.concat(F.lit("p"), "o", F.lit(".JPG"), status).alias("Name"),
        F.concat(F.lit("/image/"), text("o"), F.lit("/view/")).alias("Image Page"),
    )
    annotations, skipped = source_files.read_source_annotations(spark, f"{root}/*/source_id=*/*.csv")
    return source_files.resolve_images(annotations, source_files.name_map(images)), skipped


@query(
    "source_annotation_files",
    f"""WITH {ANNOTATED} SELECT source_id, image_id, "Row", "Column", "Label ID" FROM resolved WHERE image_id IS NOT NULL""",
)
def _(spark, sf):
    resolved, _ = _source_files(spark, sf)
    return source_files.mapped_rows(resolved).select("source_id", "image_id", "Row", "Column", "Label ID")


@query(
    "source_annotations_resolved",
    f"""WITH {ANNOTATED} SELECT source_id, image_id AS "Image ID", "Row", "Column", "Label ID" FROM resolved
        WHERE image_id IS NOT NULL""",
)
def _(spark, sf):
    resolved, _ = _source_files(spark, sf)
    root = _path(spark, "resolved")
    kept = source_files.mapped_rows(resolved).drop("Name", "Taken, by")
    sinks.write_annotations_by_source(kept, root)
    rows, _ = source_files.read_source_annotations(spark, f"{root}/source_id=*/*.csv")
    return rows.select("source_id", "Image ID", "Row", "Column", "Label ID")


@query(
    "image_lists",
    """SELECT CAST(o_custkey % 7 AS VARCHAR) AS source_id, 'p' || o_custkey || '.JPG' AS name_norm, CAST(max(o_orderkey) AS VARCHAR) AS image_id
       FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    root = _path(spark, "lists")
    listed = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 7).alias("source_id"),
        F.concat(F.lit("p"), "o_custkey", F.lit(".JPG - Confirmed")).alias("Name"),
        F.concat(F.lit("/image/"), "o_orderkey", F.lit("/view/")).alias("Image Page"),
        "o_orderkey",
    )
    one_file = listed.repartition("source_id").sortWithinPartitions("source_id", "o_orderkey").drop("o_orderkey")
    one_file.write.partitionBy("source_id").csv(root, header=True)
    return source_files.read_image_lists(spark, f"{root}/source_id=*/*.csv")


@query(
    "raw_tables_read",
    """SELECT l_suppkey AS source_id, CAST(l_orderkey AS VARCHAR) AS image_id, l_partkey AS "row", l_linenumber AS col,
       l_partkey AS label_id FROM lineitem""",
)
def _(spark, sf):
    annotations, images = _path(spark, "raw"), _path(spark, "raw")
    raw_annotations(spark, sf).write.parquet(annotations)
    raw_images(spark, sf).write.parquet(images)
    return tables.read_raw(spark, annotations, images)[0]


@query(
    "source_rows_unmapped",
    f"""WITH {ANNOTATED} SELECT source_id, count(*) AS rows, count(*) FILTER (WHERE image_id IS NULL) AS unmapped
        FROM resolved GROUP BY 1""",
)
def _(spark, sf):
    resolved, _ = _source_files(spark, sf)
    return source_files.unmapped_counts(resolved)


@query(
    "sources_available",
    """SELECT doc_id AS source_id, 'present' AS state FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
       UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark, sf):
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"))
    listing = table(spark, sf, "labels").select(F.col("doc_id").alias("source_id"))
    present, missing = source_files.split_available(wanted, listing)
    return present.withColumn("state", F.lit("present")).union(missing.withColumn("state", F.lit("missing")))


@query(
    "sources_missing_named",
    """SELECT doc_id AS source_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 20""",
)
def _(spark, sf):
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"))
    listing = table(spark, sf, "labels").select(F.col("doc_id").alias("source_id"))
    return source_files.first_missing(source_files.split_available(wanted, listing)[1])


@query(
    "work_log_appended",
    "SELECT event_type AS outcome, 2 * count(*) AS n FROM events GROUP BY 1",
)
def _(spark, sf):
    path = _path(spark, "log")
    log = table(spark, sf, "events").select(
        text("user_id").alias("source_id"), text("event_id").alias("image_id"), F.col("event_type").alias("outcome")
    )
    sinks.append_work_log(log, path)
    sinks.append_work_log(log, path)
    return runs.outcome_counts(spark.read.json(path, schema="ts string, source_id string, image_id string, outcome string"))


@query(
    "failure_log",
    """SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(event_id AS VARCHAR) AS image_id, props AS error_msg
       FROM events WHERE event_type = 'error'""",
)
def _(spark, sf):
    path = _path(spark, "log")
    log = table(spark, sf, "events").select(
        text("ts").alias("ts"),
        text("user_id").alias("source_id"),
        text("event_id").alias("image_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"),
        F.lit("ValueError").alias("error_type"),
        F.col("props").alias("error_msg"),
    )
    sinks.append_failures(log, path)
    return spark.read.csv(path, header=True).select("source_id", "image_id", "error_msg")


@query(
    "report_csv",
    "SELECT o_orderpriority, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1",
)
def _(spark, sf):
    path = _path(spark, "report")
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_csv(counts, path)
    return spark.read.csv(path, header=True)
