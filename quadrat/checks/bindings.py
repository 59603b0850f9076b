"""Point-label tables derived from the driver's tables, in Spark and as SQL common table expressions.

Points are line items (image = order, row = part, col = line number, source = supplier, class =
part type and return flag); the taxonomy is region, nation, supplier; predictions compare supplier
and customer nations; probabilities are the softmax of ten logits, logit k being the sum of the embedding values j with j % 10 = k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.keys import class_key, provider_feature_path
from quadrat.functions.numbers import softmax
from quadrat.operators.taxonomy import class_list, class_table, paths

POINT_ORDER = ["site", "project_id", "image_id", "row", "col", "qty"]
PREDICTION_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles so that two engines print them alike; adding 0 removes a negative zero."""
    return df.select(
        *[
            (F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def q(expression: str, places: int = 6) -> str:
    """The SQL counterpart of ``tidy`` for one expression."""
    return f"round({expression}, {places}) + 0.0"


# --- points -----------------------------------------------------------------------------------


def form_of(flag: str) -> Column:
    return F.when(F.col(flag) == "N", "").otherwise(F.col(flag))


def bare_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points without a class, as read from a manifest."""
    line = table(spark, sf, "lineitem")
    return line.select(
        F.lit("provider").alias("site"),
        text("l_suppkey").alias("project_id"),
        text("l_orderkey").alias("image_id"),
        F.col("l_partkey").alias("row"),
        F.col("l_linenumber").alias("col"),
        F.col("l_quantity").cast("int").alias("qty"),
        text("l_partkey").alias("label_id"),
        F.lit("features").alias("bucket"),
        provider_feature_path(F.col("l_suppkey"), F.col("l_orderkey")).alias("feature_vector"),
        form_of("l_returnflag").alias("flag_form"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Points with their class (part type, return flag)."""
    part = table(spark, sf, "part").select(
        text("p_partkey").alias("label_id"), F.col("p_type").alias("attribute_id")
    )
    return bare_points(spark, sf).withColumnRenamed("flag_form", "form_id").join(part, "label_id")


BARE_POINTS = """bare_points AS (
  SELECT 'provider' AS site, CAST(l_suppkey AS VARCHAR) AS project_id,
         CAST(l_orderkey AS VARCHAR) AS image_id, l_partkey AS "row", l_linenumber AS col,
         CAST(l_quantity AS INTEGER) AS qty, CAST(l_partkey AS VARCHAR) AS label_id,
         'features' AS bucket,
         's' || l_suppkey || '/features/i' || l_orderkey || '.featurevector' AS feature_vector,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag_form
  FROM lineitem)"""
POINTS = (
    BARE_POINTS
    + """, points AS (
  SELECT site, project_id, image_id, "row", col, qty, label_id, bucket, feature_vector,
         p_type AS attribute_id, flag_form AS form_id
  FROM bare_points JOIN part ON label_id = CAST(p_partkey AS VARCHAR))"""
)


def label_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Provider labels: parts by brand and type; large parts are not mapped."""
    part = table(spark, sf, "part").where(F.col("p_size") <= 40)
    return part.select(
        text("p_partkey").alias("provider_id"),
        F.col("p_name").alias("provider_label"),
        F.col("p_type").alias("attribute_id"),
        F.when(F.col("p_size") <= 20, F.lit(None)).otherwise(F.col("p_brand")).alias("form_id"),
    )


MAPPING = """mapping AS (
  SELECT CAST(p_partkey AS VARCHAR) AS provider_id, p_type AS attribute_id,
         CASE WHEN p_size <= 20 THEN '' ELSE p_brand END AS form_id
  FROM part WHERE p_size <= 40)"""


def raw_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source_id"),
        text("l_orderkey").alias("image_id"),
        F.col("l_partkey").alias("row"),
        F.col("l_linenumber").alias("col"),
        F.col("l_partkey").alias("label_id"),
        F.col("l_linestatus").alias("status"),
    )


def raw_images(spark: SparkSession, sf: str) -> DataFrame:
    """One image row per (source, order); an image is valid when its order is finished."""
    # Dealt by order, pairs are made distinct and joined with their order where they are.
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey").repartition("l_orderkey").distinct()
    orders = table(spark, sf, "orders")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("source_id"),
        text("o_orderkey").alias("image_id"),
        F.when(F.col("o_totalprice") >= 20000, F.concat(F.lit("img/"), text("o_orderkey"))).alias("s3_key"),
        F.floor("o_totalprice").cast("int").alias("width"),
        F.floor(F.col("o_totalprice") / 2).cast("int").alias("height"),
        F.when(F.col("o_orderstatus") == "F", "ok").otherwise("header_read_failed").alias("header_status"),
    )


RAW = """ann AS (
  SELECT l_suppkey AS source_id, CAST(l_orderkey AS VARCHAR) AS image_id, l_partkey AS "row",
         l_linenumber AS col, l_partkey AS label_id FROM lineitem),
img AS (
  SELECT DISTINCT l_suppkey AS source_id, CAST(o_orderkey AS VARCHAR) AS image_id,
         CASE WHEN o_totalprice >= 20000 THEN 'img/' || o_orderkey END AS s3_key,
         CAST(floor(o_totalprice) AS INTEGER) AS width,
         CAST(floor(o_totalprice / 2) AS INTEGER) AS height,
         CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'header_read_failed' END AS header_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
MANIFEST = (
    RAW
    + """, manifest AS (
  SELECT a.source_id, a.image_id, a."row", a.col, a.label_id,
         CAST(NULL AS VARCHAR) AS source_label_name, i.s3_key AS image_s3_key,
         i.width AS load_width, i.height AS load_height, FALSE AS uses_resized_image
  FROM ann a JOIN img i ON a.source_id = i.source_id AND a.image_id = i.image_id
  WHERE i.header_status = 'ok' AND i.s3_key IS NOT NULL)"""
)


# --- taxonomy ---------------------------------------------------------------------------------


def nodes(spark: SparkSession, sf: str, leaves: bool = True) -> DataFrame:
    """Region, nation and (as leaves) supplier nodes."""
    region = table(spark, sf, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"),
        F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("parent"),
    )
    nation = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("r"), "n_regionkey").alias("parent"),
    )
    both = region.union(nation)
    if not leaves:
        return both
    supplier = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("n"), "s_nationkey").alias("parent"),
    )
    return both.union(supplier)


NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey FROM supplier)"""
CLOSURE = (
    NODES
    + """, closure AS (
  SELECT id, id AS ancestor, 0 AS distance FROM nodes
  UNION ALL SELECT id, parent, 1 FROM nodes WHERE parent IS NOT NULL
  UNION ALL SELECT c.id, p.parent, 2 FROM nodes c JOIN nodes p ON c.parent = p.id
            WHERE p.parent IS NOT NULL)"""
)


# --- predictions ------------------------------------------------------------------------------


def form_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", "Arm"), ("R", "Round")], "id string, name string")


def nation_walk(spark: SparkSession, sf: str) -> DataFrame:
    return paths(nodes(spark, sf, leaves=False))


def nation_classes(spark: SparkSession, sf: str, walked: DataFrame | None = None) -> DataFrame:
    """Every nation without a form and with each form."""
    keyed = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("a"), F.explode(F.array(F.lit(""), F.lit("A"), F.lit("R"))).alias("f")
    )
    keys = keyed.select(class_key("a", "f").alias("class_id"))
    return class_table(class_list(keys), walked or nation_walk(spark, sf), form_names(spark))


def predictions(spark: SparkSession, sf: str, scored: bool = False) -> DataFrame:
    """gt from the supplier's nation and return flag, est from the customer's nation and order status."""
    line = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
    )
    est_form = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "R").otherwise("")
    out = joined.select(
        *PREDICTION_KEY,
        text("l_orderkey").alias("image_key"),
        F.concat(F.lit("provider:"), "l_suppkey").alias("source_key"),
        class_key(F.concat(F.lit("n"), "s_nationkey"), form_of("l_returnflag")).alias("gt"),
        class_key(F.concat(F.lit("n"), "c_nationkey"), est_form).alias("est"),
        "l_extendedprice",
    )
    if scored:
        top = line.agg(F.max("l_extendedprice")).first()[0]
        out = out.withColumn("score", F.col("l_extendedprice") / F.lit(top + 1.0))
    return out


PREDS = """preds AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
         CAST(l_orderkey AS VARCHAR) AS image_key, 'provider:' || l_suppkey AS source_key,
         'n' || s_nationkey AS gt_attr,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS gt_form,
         'n' || c_nationkey AS est_attr,
         CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'R' ELSE '' END AS est_form,
         'n' || s_nationkey || '::' || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS gt,
         'n' || c_nationkey || '::' ||
           CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'R' ELSE '' END AS est,
         l_extendedprice / ((SELECT max(l_extendedprice) FROM lineitem) + 1.0) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN customer ON o_custkey = c_custkey)"""
CELLS = (
    PREDS
    + """, cells AS (SELECT gt, est, count(*) AS n FROM preds GROUP BY gt, est),
forms AS (SELECT * FROM (VALUES ('', ''), ('A', 'Arm'), ('R', 'Round')) AS f(form_id, form_name)),
classes AS (
  SELECT 'n' || n_nationkey || '::' || form_id AS class_id, 'n' || n_nationkey AS attribute_id,
         form_id, form_name, 'r' || r_regionkey AS root, r_name AS root_name, n_name AS attribute_name,
         CASE WHEN form_id = '' THEN n_name ELSE n_name || '::' || form_name END AS class_name
  FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN forms),
sides AS (
  SELECT label, CAST(sum(t) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted,
         CAST(sum(c) AS BIGINT) AS correct
  FROM (SELECT gt AS label, n AS t, 0 AS p, CASE WHEN gt = est THEN n ELSE 0 END AS c FROM cells
        UNION ALL SELECT est, 0, n, 0 FROM cells) u
  GROUP BY label),
scores AS (
  SELECT label, support, predicted, correct,
         CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(correct AS DOUBLE) / predicted END AS "precision",
         CASE WHEN support = 0 THEN 0.0 ELSE CAST(correct AS DOUBLE) / support END AS recall,
         CASE WHEN correct = 0 THEN 0.0 ELSE 2.0 * correct / (predicted + support) END AS f1
  FROM sides)"""
)


# --- probabilities ----------------------------------------------------------------------------


def probs(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, gt_idx, proba) over ten classes; every value of a vector counts."""

    def logit(k: int) -> Column:
        own = F.filter("embedding", lambda _, j: j % 10 == k)
        return F.aggregate(own, F.lit(0.0), lambda total, x: total + x)

    logits = F.array(*[logit(k) for k in range(10)])
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("gt_idx"), softmax(logits).alias("proba")
    )


def prob_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The ten classes as nations without form; the class order is the label order."""
    keys = table(spark, sf, "embeddings").select(
        class_key(F.concat(F.lit("n"), "label"), F.lit("")).alias("class_id")
    )
    return class_table(class_list(keys), nation_walk(spark, sf))


PROBS = """emb AS (
  SELECT vec_id, gt, j % 10 AS k, sum(v) AS x FROM (
    SELECT vec_id, label AS gt, generate_subscripts(embedding, 1) - 1 AS j,
           CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) e GROUP BY 1, 2, 3),
expd AS (SELECT vec_id, gt, k, exp(x - max(x) OVER (PARTITION BY vec_id)) AS u FROM emb),
probs AS (SELECT vec_id, gt, k, u / sum(u) OVER (PARTITION BY vec_id) AS p FROM expd)"""
RANKS = (
    PROBS
    + """, truth AS (SELECT vec_id, gt, p AS p_true FROM probs WHERE k = gt),
ranks AS (
  SELECT t.vec_id, t.gt, t.p_true, 1 + count(*) FILTER (
           WHERE p.p > t.p_true OR (p.p = t.p_true AND p.k < t.gt)) AS "rank"
  FROM truth t JOIN probs p ON t.vec_id = p.vec_id GROUP BY t.vec_id, t.gt, t.p_true),
cats AS (SELECT n_nationkey AS gt, 'r' || r_regionkey AS root, r_name AS category
         FROM nation JOIN region ON n_regionkey = r_regionkey)"""
)
