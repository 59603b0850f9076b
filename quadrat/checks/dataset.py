"""Queries on dataset preparation, with their SQL counterparts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.checks.bindings import (
    BARE_POINTS,
    MANIFEST,
    MAPPING,
    POINT_ORDER,
    POINTS,
    bare_points,
    label_mapping,
    points,
    q,
    raw_annotations,
    raw_images,
    table,
    text,
    tidy,
)
from quadrat.functions import keys
from quadrat.functions import text as texts
from quadrat.functions.numbers import confidence_band, half_even, score_percent
from quadrat.operators import allocate, features, manifest, prepare, runs, split, weights
from quadrat.operators.staging import stage, staging_root
from quadrat.operators.subsample import audit, realized_total, subsample
from quadrat.plans.dataset import DatasetOptions, build_dataset
from quadrat.sources import sinks, specs, tables

# --- rules used below -------------------------------------------------------------------------

ROLLUP = [
    ("ECONOMY", "A", "STANDARD", ""),
    ("ECONOMY", "", "STANDARD", "R"),
    ("STANDARD", "", "PROMO", ""),
    ("LARGE", "R", "LARGE", ""),
]
ROLLUP_SCHEMA = "from_attribute_id string, from_form_id string, to_attribute_id string, to_form_id string"
LISTED = [("STANDARD", ""), ("STANDARD", "R"), ("PROMO", ""), ("MEDIUM", "A"), ("LARGE", "")]
LISTED_SCHEMA = "attribute_id string, form_id string"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


RULES = f"""rules AS (SELECT * FROM (VALUES {_values(ROLLUP)}) AS r(fa, ff, ta, tf)),
listed AS (SELECT * FROM (VALUES {_values(LISTED)}) AS l(la, lf))"""
ROLLED = f"""{POINTS}, {RULES}, rolled AS (
  SELECT site, project_id, image_id, "row", col, qty, label_id, bucket, feature_vector,
         coalesce(ta, attribute_id) AS attribute_id, coalesce(tf, form_id) AS form_id
  FROM points LEFT JOIN rules ON attribute_id = fa AND form_id = ff),
filtered AS (
  SELECT r.* FROM rolled r SEMI JOIN listed ON attribute_id = la AND form_id = lf)"""


def _rules(spark):
    return spark.createDataFrame(ROLLUP, ROLLUP_SCHEMA)


def _listed(spark):
    return spark.createDataFrame(LISTED, LISTED_SCHEMA)


def _path(spark, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# --- manifest ---------------------------------------------------------------------------------


@query("manifest_join", f"WITH {MANIFEST} SELECT * FROM manifest")
def _(spark, sf):
    return manifest.build_manifest(raw_annotations(spark, sf), raw_images(spark, sf))


@query(
    "manifest_of_sources",
    f"""WITH {MANIFEST} SELECT * FROM manifest SEMI JOIN
        (SELECT s_suppkey AS source_id FROM supplier WHERE s_acctbal > 0) s USING (source_id)""",
)
def _(spark, sf):
    wanted = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source_id"))
    return manifest.build_manifest(raw_annotations(spark, sf), raw_images(spark, sf), wanted)


@query(
    "manifest_summary",
    f"""WITH {MANIFEST} SELECT i.n AS points_in, k.n AS points_kept,
        i.n - k.n AS points_dropped_invalid_image, k.s AS sources_out
        FROM (SELECT count(*) AS n FROM ann) i,
             (SELECT count(*) AS n, count(DISTINCT source_id) AS s FROM manifest) k""",
)
def _(spark, sf):
    return manifest.summarize_build(raw_annotations(spark, sf), raw_images(spark, sf))


@query(
    "manifest_write_read",
    f"""WITH {MANIFEST} SELECT "row", col, image_id, CAST(label_id AS VARCHAR) AS label_id,
        'provider' AS site, 'features' AS bucket, CAST(source_id AS VARCHAR) AS project_id,
        's' || source_id || '/features/i' || image_id || '.featurevector' AS feature_vector
        FROM manifest WHERE image_id IS NOT NULL AND image_id <> ''""",
)
def _(spark, sf):
    path = _path(spark, "manifest")
    built = manifest.build_manifest(raw_annotations(spark, sf), raw_images(spark, sf))
    sinks.write_manifest(built, path)
    return tables.read_manifest(spark, path)


@query(
    "audit_flagged_sources",
    "SELECT s_suppkey AS source_id FROM supplier WHERE s_acctbal < 0 OR s_nationkey > 20",
)
def _(spark, sf):
    audited = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("source_id"),
        (F.col("s_acctbal") >= 0).alias("is_complete"),
        (F.col("s_nationkey") <= 20).alias("image_count_match"),
    )
    return tables.flagged_sources(audited)


NATIVE = """native AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS image_id, l_partkey AS "row", l_linenumber AS col,
         p_type AS attribute_id, CASE WHEN l_returnflag = 'N' THEN 'None' ELSE l_returnflag END AS form_id,
         'native' AS site, 'native-features' AS bucket, 'all' AS project_id,
         'native/' || l_orderkey || '_featurevector' AS feature_vector
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _native(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("attribute_id"))
    line = table(spark, sf, "lineitem")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        text("l_orderkey").alias("image_id"),
        F.col("l_partkey").alias("row"),
        F.col("l_linenumber").alias("col"),
        "attribute_id",
        F.when(F.col("l_returnflag") == "N", "None").otherwise(F.col("l_returnflag")).alias("form_id"),
    )


@query("native_read", f"WITH {NATIVE} SELECT * FROM native")
def _(spark, sf):
    path = _path(spark, "native")
    _native(spark, sf).write.parquet(path)
    return tables.read_native(spark, path)


@query(
    "native_appended",
    f"""WITH {NATIVE}, {POINTS} SELECT site, attribute_id,
        CASE WHEN form_id = 'None' THEN '' ELSE form_id END AS form_id,
        count(*) AS n, count(label_id) AS labelled
        FROM (SELECT site, attribute_id, form_id, label_id FROM points UNION ALL
              SELECT site, attribute_id, form_id, NULL FROM native) u GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    both = prepare.append_native(points(spark, sf), tables.to_native_points(_native(spark, sf)))
    return (
        prepare.normal_forms(both)
        .groupBy("site", *prepare.CLASS)
        .agg(F.count(F.lit(1)).alias("n"), F.count("label_id").alias("labelled"))
    )


# --- specifications ---------------------------------------------------------------------------


@query(
    "spec_csv_blanks_kept",
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
       CASE WHEN s_acctbal < 0 THEN '' ELSE 'paid' END AS note FROM supplier""",
)
def _(spark, sf):
    path = _path(spark, "csv")
    sinks.write_csv(
        table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") < 0, "").otherwise("paid").alias("note"),
        ),
        path,
    )
    return specs.read_text_csv(spark, path)


@query(
    "filter_spec_csv",
    """SELECT DISTINCT p_type AS attribute_id,
       CASE WHEN p_size <= 20 THEN '' ELSE p_brand END AS form_id FROM part""",
)
def _(spark, sf):
    path = _path(spark, "csv")
    sinks.write_csv(
        table(spark, sf, "part").select(
            F.col("p_name").alias("remark"),
            F.when(F.col("p_size") <= 20, "").otherwise(F.col("p_brand")).alias("gf_id"),
            F.col("p_type").alias("ba_id"),
        ),
        path,
    )
    return specs.load_filter(spark, path)


@query(
    "source_list_csv",
    """SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN o_custkey || 'd' ELSE CAST(o_custkey AS VARCHAR) END AS source_id
       FROM orders WHERE o_totalprice >= 5000""",
)
def _(spark, sf):
    path = _path(spark, "csv")
    listed = table(spark, sf, "orders").select(
        F.when(F.col("o_totalprice") < 5000, "nan")
        .when(F.col("o_custkey") % 3 == 0, F.concat(text("o_custkey"), F.lit("d")))
        .when(F.col("o_orderstatus") == "F", F.concat(text("o_custkey"), F.lit(".0")))
        .otherwise(F.concat(F.lit(" "), text("o_custkey")))
        .alias("Source ID"),
        F.col("o_orderstatus").alias("note"),
    )
    sinks.write_csv(listed, path)
    return specs.load_source_ids(spark, path).select("source_id")


@query(
    "keep_first_per_key",
    """SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey,
       arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("_line")
    )
    return specs.first_per_key(orders, ["o_custkey"]).drop("_line")


@query(
    "keep_last_per_key",
    """SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey,
       arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("_line")
    )
    return specs.last_per_key(orders, ["o_custkey"])


@query(
    "work_shards",
    """SELECT s_suppkey AS item, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) % 7 AS INTEGER) AS shard
       FROM supplier""",
)
def _(spark, sf):
    items = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item"))
    return runs.shards(items, 7, ["item"])


# --- columns ----------------------------------------------------------------------------------


@query(
    "class_keys",
    f"""WITH {POINTS} SELECT attribute_id || '::' || form_id AS class_key, attribute_id AS attribute,
        form_id AS form, site || ':' || project_id AS source_key, site AS source_site,
        project_id AS source_id, bucket || '/' || feature_vector AS feature_full, count(*) AS n
        FROM points GROUP BY ALL""",
)
def _(spark, sf):
    keyed = points(spark, sf).select(
        keys.class_key("attribute_id", "form_id").alias("class_key"),
        keys.source_key("site", "project_id").alias("source_key"),
        keys.full_path().alias("feature_full"),
    )
    parts, source = keys.class_parts("class_key"), keys.source_parts("source_key")
    return (
        keyed.groupBy("class_key", "source_key", "feature_full")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "class_key",
            parts["attribute"].alias("attribute"),
            parts["form"].alias("form"),
            "source_key",
            source["site"].alias("source_site"),
            source["source_id"].alias("source_id"),
            "feature_full",
            "n",
        )
    )


@query(
    "class_display_names",
    f"""WITH {POINTS}, forms AS (SELECT * FROM (VALUES ('A', 'Arm'), ('R', 'Round')) f(id, name))
        SELECT attribute_id || '::' || form_id AS class_key,
               CASE WHEN form_id = '' THEN lower(attribute_id) ELSE lower(attribute_id) || '::' || name END AS class_name,
               count(*) AS n
        FROM points LEFT JOIN forms ON form_id = id GROUP BY ALL""",
)
def _(spark, sf):
    counts = prepare.class_counts(points(spark, sf))
    forms = spark.createDataFrame([("A", "Arm"), ("R", "Round")], "form_id string, form_name string")
    return counts.join(forms, "form_id", "left").select(
        keys.class_key("attribute_id", "form_id").alias("class_key"),
        keys.display_name(F.lower("attribute_id"), F.col("form_id"), F.col("form_name")).alias("class_name"),
        "n",
    )


@query(
    "transform_native",
    f"""WITH {POINTS} SELECT image_id, "row", col, lower(attribute_id) AS attribute_id, form_id FROM points""",
)
def _(spark, sf):
    base = points(spark, sf).select("image_id", "row", "col", "attribute_id", "form_id")
    return prepare.map_distinct(base, "attribute_id", F.lower)


@query(
    "transform_by_function",
    f"""WITH {POINTS} SELECT image_id, "row", col, attribute_id, reverse(attribute_id) AS flipped FROM points""",
)
def _(spark, sf):
    base = points(spark, sf).select("image_id", "row", "col", "attribute_id")
    return prepare.map_distinct(base, "attribute_id", lambda s: s[::-1], "flipped", "string")


@query(
    "replace_column",
    f"""WITH {POINTS} SELECT image_id, "row", col, attribute_id || '/' || form_id AS attribute_id FROM points""",
)
def _(spark, sf):
    base = points(spark, sf).select(
        "image_id", "row", "col", "attribute_id", F.concat_ws("/", "attribute_id", "form_id").alias("spare")
    )
    return prepare.replace_column(base, "attribute_id", "spare")


@query(
    "filter_by_function",
    f"""WITH {POINTS} SELECT image_id, "row", col, label_id FROM points WHERE length(attribute_id) > 5""",
)
def _(spark, sf):
    kept = prepare.keep_where(points(spark, sf), "attribute_id", lambda s: len(s) > 5, python=True)
    return kept.select("image_id", "row", "col", "label_id")


@query(
    "file_name_cleanup",
    r"""SELECT o_orderkey, 'img-' || o_orderkey || '.JPG' AS name_norm,
        CAST(o_orderkey AS VARCHAR) AS image_id FROM orders""",
)
def _(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", " - Confirmed").when(
        F.col("o_orderstatus") == "O", " -  Unconfirmed "
    ).otherwise("   - Unclassified")
    names = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("img-"), text("o_orderkey"), F.lit(".JPG"), status).alias("name"),
        F.concat(F.lit("/image/"), text("o_orderkey"), F.lit("/view/")).alias("page"),
    )
    return names.select(
        "o_orderkey",
        texts.strip_status(F.col("name")).alias("name_norm"),
        texts.image_of_page(F.col("page")).alias("image_id"),
    )


@query(
    "id_normalisation",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR)
       WHEN 'O' THEN CASE o_custkey % 4 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN o_custkey || 'd' WHEN 2 THEN o_custkey || 'F'
         ELSE CAST(10 * o_custkey AS VARCHAR) END ELSE NULL END AS id FROM orders""",
)
def _(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(text("o_custkey"), F.lit(".0 "))).when(
        F.col("o_orderstatus") == "O",
        F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit(" c"), text("o_custkey")))
        .when(F.col("o_custkey") % 4 == 1, F.concat(text("o_custkey"), F.lit("d ")))
        .when(F.col("o_custkey") % 4 == 2, F.concat(text("o_custkey"), F.lit("F")))
        .otherwise(F.concat(text("o_custkey"), F.lit("e1"))),
    ).otherwise(F.lit(" NaN"))
    return table(spark, sf, "orders").select("o_orderkey", texts.normal_id(raw).alias("id"))


@query(
    "confidence_bands",
    """WITH s AS (SELECT l_discount * 10 AS score FROM lineitem),
       p AS (SELECT CAST(round_even(score * 100, 0) AS INTEGER) AS score_percent FROM s)
       SELECT score_percent, CASE WHEN score_percent >= 70 THEN 'high'
         WHEN score_percent >= 50 THEN 'medium' ELSE 'low' END AS band, count(*) AS n
       FROM p GROUP BY 1, 2""",
)
def _(spark, sf):
    score = F.col("l_discount") * 10
    return (
        table(spark, sf, "lineitem")
        .groupBy(score_percent(score).alias("score_percent"), confidence_band(score).alias("band"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "half_even_rounding",
    """SELECT l_quantity / 8 AS value, round_even(l_quantity / 8, 2) AS two_places,
       round_even(l_quantity / 2, 0) AS whole, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def _(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            (F.col("l_quantity") / 8).alias("value"),
            half_even(F.col("l_quantity") / 8, 2).alias("two_places"),
            half_even(F.col("l_quantity") / 2, 0).alias("whole"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "kept_forms",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size <= 10 THEN ' massive ' WHEN p_size <= 20 THEN 'BRANCHING'
         WHEN p_size <= 30 THEN 'branching, massive' WHEN p_size <= 40 THEN ' ' ELSE p_name END AS form, p_size
         FROM part)
       SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'Massive' WHEN p_size <= 20 THEN 'Branching' ELSE '' END AS kept,
         CASE WHEN p_size <= 10 THEN 'Massive' WHEN p_size <= 20 THEN 'Branching'
              WHEN p_size <= 40 THEN NULL ELSE '' END AS inherent FROM t""",
)
def _(spark, sf):
    form = (
        F.when(F.col("p_size") <= 10, " massive ")
        .when(F.col("p_size") <= 20, "BRANCHING")
        .when(F.col("p_size") <= 30, "branching, massive")
        .when(F.col("p_size") <= 40, " ")
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf, "part").select(
        "p_partkey", texts.kept_form(form).alias("kept"), texts.inherent_form(form).alias("inherent")
    )


# --- mapping, rollup, filter --------------------------------------------------------------------

MAPPED = f"""{BARE_POINTS}, {MAPPING}, mapped AS (
  SELECT b.*, m.attribute_id, m.form_id FROM bare_points b LEFT JOIN mapping m ON label_id = provider_id)"""


def _mapped(spark, sf):
    return prepare.map_labels(bare_points(spark, sf).drop("flag_form"), label_mapping(spark, sf))


@query(
    "labels_mapped",
    f"""WITH {MAPPED} SELECT site, project_id, image_id, "row", col, qty, label_id, attribute_id, form_id
        FROM mapped WHERE attribute_id IS NOT NULL""",
)
def _(spark, sf):
    out = prepare.drop_unmapped(_mapped(spark, sf))
    return out.select(*POINT_ORDER, "label_id", *prepare.CLASS)


@query(
    "labels_unmapped",
    f"""WITH {MAPPED} SELECT label_id, count(*) AS num_annotations, count(DISTINCT project_id) AS num_projects
        FROM mapped WHERE attribute_id IS NULL GROUP BY label_id""",
)
def _(spark, sf):
    return prepare.unmapped_labels(_mapped(spark, sf))


@query(
    "forms_cleared",
    f"WITH {POINTS} SELECT attribute_id, '' AS form_id, count(*) AS n FROM points GROUP BY 1, 2",
)
def _(spark, sf):
    return prepare.class_counts(prepare.clear_forms(points(spark, sf)))


@query("class_counts", f"WITH {POINTS} SELECT attribute_id, form_id, count(*) AS n FROM points GROUP BY 1, 2")
def _(spark, sf):
    return prepare.class_counts(points(spark, sf))


@query(
    "stage_counts",
    f"""WITH {POINTS} SELECT 'read' AS stage, count(*) AS annotations,
        count(DISTINCT feature_vector) AS images FROM points""",
)
def _(spark, sf):
    return prepare.stage_counts(points(spark, sf), "read")


@query(
    "project_stats",
    f"""WITH {POINTS} SELECT site, project_id, count(DISTINCT image_id) AS num_images,
        count(*) AS num_annotations FROM points GROUP BY 1, 2""",
)
def _(spark, sf):
    return prepare.project_stats(points(spark, sf), "provider")


@query("source_ids", f"WITH {POINTS} SELECT DISTINCT project_id FROM points")
def _(spark, sf):
    return prepare.source_id_list(points(spark, sf))


@query(
    "rollup",
    f"""WITH {ROLLED} SELECT site, project_id, image_id, "row", col, qty, attribute_id, form_id FROM rolled""",
)
def _(spark, sf):
    return prepare.roll_up(points(spark, sf), _rules(spark)).select(*POINT_ORDER, *prepare.CLASS)


@query(
    "filter_included",
    f"""WITH {ROLLED} SELECT site, project_id, image_id, "row", col, qty, attribute_id, form_id FROM filtered""",
)
def _(spark, sf):
    rolled = prepare.roll_up(points(spark, sf), _rules(spark))
    return prepare.filter_classes(rolled, include=_listed(spark)).select(*POINT_ORDER, *prepare.CLASS)


@query(
    "filter_excluded",
    f"""WITH {ROLLED} SELECT site, project_id, image_id, "row", col, qty, attribute_id, form_id
        FROM rolled ANTI JOIN listed ON attribute_id = la AND form_id = lf""",
)
def _(spark, sf):
    rolled = prepare.roll_up(points(spark, sf), _rules(spark))
    return prepare.filter_classes(rolled, exclude=_listed(spark)).select(*POINT_ORDER, *prepare.CLASS)


@query(
    "retention",
    f"""WITH {ROLLED}, c AS (
          SELECT (SELECT count(*) FROM points) AS a0, (SELECT count(*) FROM rolled) AS a1,
                 (SELECT count(*) FROM filtered) AS a2,
                 (SELECT count(DISTINCT feature_vector) FROM points) AS i0,
                 (SELECT count(DISTINCT feature_vector) FROM rolled) AS i1,
                 (SELECT count(DISTINCT feature_vector) FROM filtered) AS i2)
        SELECT a0 AS annotations_before, a1 AS annotations_rollup, a2 AS annotations_filter,
               i0 AS images_before, i1 AS images_rollup, i2 AS images_filter,
               a0 - a1 AS annotations_lost_rollup, a1 - a2 AS annotations_lost_filter,
               {q('100.0 * a2 / greatest(a0, 1)')} AS annotations_kept_pct,
               i0 - i1 AS images_lost_rollup, i1 - i2 AS images_lost_filter,
               {q('100.0 * i2 / greatest(i0, 1)')} AS images_kept_pct FROM c""",
)
def _(spark, sf):
    rolled = prepare.roll_up(points(spark, sf), _rules(spark))
    return tidy(prepare.retention_of_marked(prepare.mark_kept(rolled, include=_listed(spark))))


@query(
    "annotations_of_source",
    f"WITH {POINTS} SELECT image_id, \"row\", col, qty FROM points WHERE site = 'provider' AND project_id = '7'",
)
def _(spark, sf):
    return split.select_annotations(points(spark, sf), "s7").select("image_id", "row", "col", "qty")


@query(
    "annotations_of_image",
    f"WITH {POINTS} SELECT project_id, \"row\", col, qty FROM points WHERE site = 'provider' AND image_id = '33'",
)
def _(spark, sf):
    return split.select_annotations(points(spark, sf), "i33").select("project_id", "row", "col", "qty")


# --- allocation and subsampling ---------------------------------------------------------------


def _options(spark, sf, strategy, divisor, floor):
    total = table(spark, sf, "lineitem").count() // divisor
    return allocate.SubsampleOptions(strategy, total, floor)


def _targets(strategy: str, divisor: int, floor: int) -> str:
    if strategy == "balanced":
        return f"""{POINTS}, counts AS (SELECT attribute_id, form_id, count(*) AS n FROM points GROUP BY 1, 2),
budget AS (SELECT (SELECT count(*) FROM lineitem) // {divisor} AS total, (SELECT count(*) FROM counts) AS k),
targets AS (SELECT attribute_id, form_id, n, greatest({floor}, least(n, total // k)) AS target_n
  FROM counts, budget)"""
    return f"""{POINTS}, counts AS (SELECT attribute_id, form_id, count(*) AS n FROM points GROUP BY 1, 2),
budget AS (SELECT (SELECT count(*) FROM lineitem) // {divisor} AS total, (SELECT sum(n) FROM counts) AS s),
base AS (SELECT attribute_id, form_id, n, total, greatest({floor},
    least(n, CAST(round_even(CAST(total * n AS DOUBLE) / s, 0) AS BIGINT))) AS t FROM counts, budget),
room AS (SELECT *, greatest(t - {floor}, 0) AS room, sum(t) OVER () - total AS excess FROM base),
cum AS (SELECT *, sum(room) OVER (ORDER BY n DESC, attribute_id, form_id ROWS UNBOUNDED PRECEDING) AS upto FROM room),
targets AS (SELECT attribute_id, form_id, n,
  CAST(t - least(room, greatest(0, excess - (upto - room))) AS BIGINT) AS target_n FROM cum)"""


def _kept(strategy: str, divisor: int, floor: int) -> str:
    return f"""{_targets(strategy, divisor, floor)}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY attribute_id, form_id
    ORDER BY site, project_id, image_id, "row", col, qty) AS rn FROM points),
kept AS (SELECT d.* FROM numbered d JOIN targets t USING (attribute_id, form_id) WHERE rn <= target_n)"""


for _name, _strategy, _divisor, _floor in (
    ("stratified_targets", "stratified", 4, 0),
    ("stratified_targets_trimmed", "stratified", 40, 150),
    ("balanced_targets", "balanced", 4, 50),
):

    def _run(spark, sf, strategy=_strategy, divisor=_divisor, floor=_floor):
        return allocate.class_targets(
            _options(spark, sf, strategy, divisor, floor), prepare.class_counts(points(spark, sf))
        )

    QUERIES[_name] = (_run, f"WITH {_targets(_strategy, _divisor, _floor)} SELECT * FROM targets")


def _subsample(spark, sf, strategy, divisor, floor):
    return subsample(points(spark, sf), _options(spark, sf, strategy, divisor, floor), POINT_ORDER)


@query(
    "subsample_stratified",
    f"""WITH {_kept('stratified', 3, 10)} SELECT site, project_id, image_id, "row", col, qty, attribute_id, form_id FROM kept""",
)
def _(spark, sf):
    return _subsample(spark, sf, "stratified", 3, 10)[0].select(*POINT_ORDER, *prepare.CLASS)


@query(
    "subsample_balanced",
    f"""WITH {_kept('balanced', 2, 50)} SELECT site, project_id, image_id, "row", col, qty, attribute_id, form_id FROM kept""",
)
def _(spark, sf):
    return _subsample(spark, sf, "balanced", 2, 50)[0].select(*POINT_ORDER, *prepare.CLASS)


_AUDIT = f"""{_kept('balanced', 2, 50)}, audited AS (
  SELECT attribute_id, form_id, n AS pre_count, target_n,
         (SELECT count(*) FROM kept k WHERE k.attribute_id = t.attribute_id AND k.form_id = t.form_id) AS realized_n
  FROM targets t)"""


@query("subsample_audit", f"WITH {_AUDIT} SELECT * FROM audited")
def _(spark, sf):
    kept, targets = _subsample(spark, sf, "balanced", 2, 50)
    return audit(targets, kept)


@query(
    "subsample_audit_table",
    f"""WITH {_AUDIT} SELECT attribute_id, lower(attribute_id) AS attribute_name, form_id,
        CASE form_id WHEN 'A' THEN 'Arm' WHEN 'R' THEN 'Round' ELSE '' END AS form_name,
        pre_count, target_n, realized_n FROM audited""",
)
def _(spark, sf):
    kept, targets = _subsample(spark, sf, "balanced", 2, 50)
    return weights.audit_table(audit(targets, kept), _type_names(spark, sf), _forms(spark))


@query(
    "subsample_realized_total",
    f"WITH {_AUDIT} SELECT CAST(sum(realized_n) AS BIGINT) AS realized_total FROM audited",
)
def _(spark, sf):
    kept, targets = _subsample(spark, sf, "balanced", 2, 50)
    return realized_total(audit(targets, kept))


# --- feature availability -----------------------------------------------------------------------

AVAILABLE = """doc AS (SELECT CAST(doc_id AS VARCHAR) AS feature_full, source FROM documents),
have AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS feature_full FROM labels)"""


def _documents(spark, sf):
    docs = table(spark, sf, "documents").select(text("doc_id").alias("feature_full"), "source")
    listing = table(spark, sf, "labels").select(text("doc_id").alias("feature_full"))
    return docs, listing


@query("missing_features", f"WITH {AVAILABLE} SELECT DISTINCT feature_full FROM doc ANTI JOIN have USING (feature_full)")
def _(spark, sf):
    return features.missing_features(*_documents(spark, sf))


@query(
    "missing_feature_counts",
    f"""WITH {AVAILABLE} SELECT count(DISTINCT feature_full) AS expected,
        count(DISTINCT feature_full) FILTER (WHERE feature_full NOT IN (SELECT feature_full FROM have)) AS missing
        FROM doc""",
)
def _(spark, sf):
    return features.missing_counts(*_documents(spark, sf))


@query(
    "missing_feature_examples",
    f"""WITH {AVAILABLE} SELECT DISTINCT feature_full FROM doc ANTI JOIN have USING (feature_full)
        ORDER BY feature_full LIMIT 3""",
)
def _(spark, sf):
    return features.example_paths(features.missing_features(*_documents(spark, sf)))


@query("features_required", f"WITH {AVAILABLE} SELECT feature_full, source FROM doc SEMI JOIN have USING (feature_full)")
def _(spark, sf):
    docs, listing = _documents(spark, sf)
    return features.require_features(docs, listing, percent_allowed=100)


@query(
    "points_by_image",
    f"""WITH {POINTS} SELECT bucket, feature_vector, count(*) AS points FROM points GROUP BY 1, 2""",
)
def _(spark, sf):
    return features.image_counts(points(spark, sf))


@query(
    "image_points",
    f"""WITH {POINTS} SELECT bucket, feature_vector, "row", col, attribute_id || '::' || form_id AS class_key FROM points""",
)
def _(spark, sf):
    return features.image_points(points(spark, sf))


def _walks_sql(key: str) -> str:
    return f"""WITH {POINTS}, steps AS (
  SELECT {key}, "row", col, coalesce(abs("row" - lag("row") OVER o) + abs(col - lag(col) OVER o), 0) AS step,
    row_number() OVER o AS k, count(*) OVER (PARTITION BY {key}) AS n
  FROM points WINDOW o AS (PARTITION BY {key} ORDER BY "row", col)
)
SELECT {key}, count(*) AS points, CAST(max("row") FILTER (k = 1) AS BIGINT) AS first_row, CAST(max(col) FILTER (k = 1) AS BIGINT) AS first_col,
  CAST(max("row") FILTER (k = n) AS BIGINT) AS last_row, CAST(max(col) FILTER (k = n) AS BIGINT) AS last_col, CAST(sum(step) AS BIGINT) AS length
FROM steps GROUP BY 1"""


@query("image_walks", _walks_sql("image_id"))
def _(spark, sf):
    return features.point_walks(points(spark, sf), ["image_id"])


@query("project_walks", _walks_sql("project_id"))
def _(spark, sf):
    return features.point_walks(points(spark, sf), ["project_id"])


_TODO = """WITH todo AS (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey, l_linenumber FROM lineitem
          ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') d ON l_orderkey = o_orderkey)"""


def _extraction(spark, sf):
    rows = bare_points(spark, sf).withColumnRenamed("project_id", "source_id")
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(text("o_orderkey").alias("image_id"))
    listing = rows.join(done, "image_id", "left_semi").select(keys.full_path().alias("feature_full"))
    return rows, tables.existing_images(listing)


@query(
    "extraction_work",
    f"""{_TODO} SELECT CAST(l_suppkey AS VARCHAR) AS source_id, CAST(l_orderkey AS VARCHAR) AS image_id, count(*) AS points,
              'in/s' || l_suppkey || '/images/' || l_orderkey || '.jpg' AS image_path,
              's' || l_suppkey || '/features/i' || l_orderkey || '.featurevector' AS feature_path
       FROM todo GROUP BY l_suppkey, l_orderkey""",
)
def _(spark, sf):
    return features.extraction_work(*_extraction(spark, sf), "in/")


@query(
    "extraction_points",
    f"""{_TODO} SELECT CAST(l_suppkey AS VARCHAR) AS source_id, CAST(l_orderkey AS VARCHAR) AS image_id, l_partkey AS "row",
              l_linenumber AS col FROM todo""",
)
def _(spark, sf):
    return features.extraction_points(*_extraction(spark, sf))


@query(
    "existing_feature_images",
    """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS source_id, CAST(l_orderkey AS VARCHAR) AS image_id
       FROM lineitem""",
)
def _(spark, sf):
    return tables.existing_images(bare_points(spark, sf).select(keys.full_path().alias("feature_full")))


@query(
    "listings_united",
    """SELECT 'd/' || doc_id AS feature_full FROM labels UNION SELECT 'd/' || doc_id FROM documents
       UNION SELECT 'p/' || page_id FROM pages""",
)
def _(spark, sf):
    def listed(name, prefix, key):
        return table(spark, sf, name).select(F.concat(F.lit(prefix), key).alias("feature_full"))

    return tables.all_listings(
        listed("labels", "d/", "doc_id"),
        listed("documents", "d/", "doc_id"),
        listed("pages", "p/", "page_id"),
    )


# --- split ------------------------------------------------------------------------------------

SPLIT = f"""{POINTS}, sizes AS (
  SELECT attribute_id, form_id, count(*) AS n, CAST(floor(count(*) * CAST('0.1' AS DECIMAL(10,6))) AS BIGINT) AS r,
         CAST(floor(count(*) * CAST('0.15' AS DECIMAL(10,6))) AS BIGINT) AS v FROM points GROUP BY 1, 2),
dealt AS (
  SELECT p.*, r, v, row_number() OVER (PARTITION BY attribute_id, form_id ORDER BY
    md5(site || '|' || project_id || '|' || image_id || '|' || "row" || '|' || col || '|' || qty),
    site, project_id, image_id, "row", col, qty) AS rn
  FROM points p JOIN sizes USING (attribute_id, form_id)),
tagged AS (
  SELECT *, CASE WHEN r = 0 OR v = 0 THEN NULL WHEN rn <= r THEN 'ref' WHEN rn <= r + v THEN 'val'
    ELSE 'train' END AS training_set FROM dealt)"""


def _split(spark, sf):
    return split.stratified_split(points(spark, sf), ("0.1", "0.15"), POINT_ORDER)


# A class per part and return flag is rare enough for some classes to be dropped by the split.
RARE = SPLIT.replace("p_type AS attribute_id", "label_id AS attribute_id")


def _rare_points(spark, sf):
    return points(spark, sf).withColumn("attribute_id", F.col("label_id"))


def _rare_split(spark, sf):
    """Image, class and set of each point, written once, as a summary reads them more than once."""
    tagged = split.stratified_split(_rare_points(spark, sf), ("0.1", "0.15"), POINT_ORDER)
    return stage(tagged.select("image_id", *prepare.CLASS, "training_set"), "split")


def _type_names(spark, sf):
    return (
        table(spark, sf, "part")
        .select(F.col("p_type").alias("id"), F.lower("p_type").alias("name"))
        .distinct()
    )


def _forms(spark):
    return spark.createDataFrame([("A", "Arm"), ("R", "Round")], "id string, name string")


@query(
    "split_rows",
    f"""WITH {SPLIT} SELECT site, project_id, image_id, "row", col, qty, training_set FROM tagged""",
)
def _(spark, sf):
    return _split(spark, sf).select(*POINT_ORDER, "training_set")


@query(
    "split_rare_classes",
    f"""WITH {RARE} SELECT attribute_id, form_id, training_set, count(*) AS n FROM tagged GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    tagged = split.stratified_split(_rare_points(spark, sf), ("0.1", "0.15"), POINT_ORDER)
    return tagged.groupBy(*prepare.CLASS, "training_set").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_tags_joined",
    f"""WITH {POINTS} SELECT project_id, image_id, "row", col, qty,
        CASE l_linestatus WHEN 'F' THEN 'ref' ELSE NULL END AS training_set
        FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_linestatus FROM lineitem
              QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_partkey, l_linenumber
                                         ORDER BY l_linestatus) = 1) l
        JOIN points ON project_id = CAST(l_suppkey AS VARCHAR) AND image_id = CAST(l_orderkey AS VARCHAR)
         AND "row" = l_partkey AND col = l_linenumber""",
)
def _(spark, sf):
    pts = points(spark, sf)
    line = table(spark, sf, "lineitem")
    keyed = line.groupBy("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber").agg(
        F.min("l_linestatus").alias("status")
    )
    assigned = keyed.where("status = 'F'").select(
        F.lit("features").alias("bucket"),
        keys.provider_feature_path(F.col("l_suppkey"), F.col("l_orderkey")).alias("feature_vector"),
        F.col("l_partkey").alias("row"),
        F.col("l_linenumber").alias("col"),
        F.lit("ref").alias("training_set"),
    )
    return split.tag_splits(pts, assigned).select("project_id", "image_id", "row", "col", "qty", "training_set")


_SETS = """count(*) FILTER (WHERE training_set = 'train') AS train,
  count(*) FILTER (WHERE training_set = 'ref') AS ref, count(*) FILTER (WHERE training_set = 'val') AS val,
  count(*) FILTER (WHERE training_set IS NULL) AS dropped"""


@query(
    "split_project_stats",
    f"""WITH {SPLIT} SELECT site, project_id, count(DISTINCT image_id) AS num_images,
        count(*) AS num_annotations, {_SETS} FROM tagged GROUP BY 1, 2""",
)
def _(spark, sf):
    return prepare.project_stats(_split(spark, sf), with_splits=True)


@query(
    "split_attribute_counts",
    f"""WITH {SPLIT} SELECT lower(attribute_id) AS attribute_name, count(DISTINCT project_id) AS num_projects,
        count(*) AS num_annotations, {_SETS}, attribute_id FROM tagged GROUP BY attribute_id""",
)
def _(spark, sf):
    return split.attribute_counts(_split(spark, sf), _type_names(spark, sf))


@query(
    "split_class_counts",
    f"""WITH {SPLIT} SELECT lower(attribute_id) AS attribute_name,
        CASE form_id WHEN 'A' THEN 'Arm' WHEN 'R' THEN 'Round' ELSE '' END AS form_name,
        count(DISTINCT project_id) AS num_projects, count(*) AS num_annotations, {_SETS},
        attribute_id, form_id FROM tagged GROUP BY attribute_id, form_id""",
)
def _(spark, sf):
    return split.class_split_counts(_split(spark, sf), _type_names(spark, sf), _forms(spark))


_SUMMARY = """summary AS (SELECT count(*) AS annotations,
  count(*) FILTER (WHERE training_set = 'train') AS annotations_train,
  count(*) FILTER (WHERE training_set = 'ref') AS annotations_ref,
  count(*) FILTER (WHERE training_set = 'val') AS annotations_val,
  count(*) FILTER (WHERE training_set IS NULL) AS annotations_dropped,
  count(DISTINCT image_id) AS images, count(DISTINCT attribute_id) AS attributes,
  count(DISTINCT attribute_id)
    - count(DISTINCT attribute_id) FILTER (WHERE training_set IS NOT NULL) AS attributes_dropped,
  count(DISTINCT attribute_id || '::' || form_id) AS classes,
  count(DISTINCT attribute_id || '::' || form_id)
    - count(DISTINCT attribute_id || '::' || form_id) FILTER (WHERE training_set IS NOT NULL) AS classes_dropped
  FROM tagged)"""


@query("split_summary", f"WITH {RARE}, {_SUMMARY} SELECT * FROM summary")
def _(spark, sf):
    return split.train_summary(_rare_split(spark, sf))


@query(
    "split_summary_text",
    f"""WITH {SPLIT}, {_SUMMARY} SELECT 'Points: ' || annotations || ' in all; train ' || annotations_train || ', ref ' || annotations_ref
        || ', val ' || annotations_val || ', without a set ' || annotations_dropped || '. Images: ' || images
        || '. Attributes: ' || attributes || '. Classes: ' || classes || '. Left without a set: attributes '
        || attributes_dropped || ', classes ' || classes_dropped || '.' AS summary FROM summary""",
)
def _(spark, sf):
    return split.summary_text(split.train_summary(_split(spark, sf)))


@query(
    "split_validation_rows",
    f"""WITH {SPLIT} SELECT site, project_id, image_id, "row", col, qty, attribute_id, form_id FROM tagged
        WHERE training_set = 'val'""",
)
def _(spark, sf):
    return split.validation_rows(_split(spark, sf)).select(*POINT_ORDER, *prepare.CLASS)


# --- weights ----------------------------------------------------------------------------------

WEIGHTS = f"""{POINTS}, counts AS (SELECT attribute_id, form_id, count(*) AS n FROM points GROUP BY 1, 2),
weights AS (SELECT attribute_id, form_id, n,
  1.0 / greatest((1.0 - pow(0.9999, CAST(n AS DOUBLE))) / (1.0 - 0.9999), 1e-12) AS weight FROM counts)"""


def _weights(spark, sf, cap=None):
    return weights.class_weights(prepare.class_counts(points(spark, sf)), weights.WeightOptions(cap))


@query("class_weights", f"WITH {WEIGHTS} SELECT attribute_id, form_id, n, {q('weight', 9)} AS weight FROM weights")
def _(spark, sf):
    return tidy(_weights(spark, sf), 9)


@query(
    "class_weights_capped",
    f"""WITH {WEIGHTS} SELECT attribute_id, form_id, n,
        {q('least(weight, (SELECT min(weight) FROM weights) * 1.05)', 9)} AS weight FROM weights""",
)
def _(spark, sf):
    return tidy(_weights(spark, sf, 1.05), 9)


@query(
    "class_weight_summary",
    f"""WITH {WEIGHTS} SELECT {q('avg(weight)', 9)} AS weight_mean, {q('median(weight)', 9)} AS weight_median,
        {q('quantile_cont(weight, 0.05)', 9)} AS weight_p5, {q('quantile_cont(weight, 0.95)', 9)} AS weight_p95,
        {q('max(weight) / min(weight)', 9)} AS weight_max_min_ratio, count(*) AS n_classes FROM weights""",
)
def _(spark, sf):
    return tidy(weights.weight_summary(_weights(spark, sf)), 9)


@query(
    "class_weight_table",
    f"""WITH {WEIGHTS} SELECT attribute_id || '::' || form_id AS class_key, attribute_id,
        lower(attribute_id) AS attribute_name, form_id,
        CASE form_id WHEN 'A' THEN 'Arm' WHEN 'R' THEN 'Round' ELSE '' END AS form_name,
        n AS count, {q('weight', 9)} AS weight FROM weights""",
)
def _(spark, sf):
    keyed = _weights(spark, sf).select(keys.class_key("attribute_id", "form_id").alias("class_key"), "n", "weight")
    return tidy(weights.weights_table(keyed, _type_names(spark, sf), _forms(spark)), 9)


# --- the whole build --------------------------------------------------------------------------

BUILD = f"""{MANIFEST}, {MAPPING},
mapped AS (SELECT m.*, p.attribute_id, p.form_id FROM manifest m JOIN mapping p
  ON CAST(m.label_id AS VARCHAR) = p.provider_id),
rules AS (SELECT * FROM (VALUES ('ECONOMY', '', 'STANDARD', '')) AS r(fa, ff, ta, tf)),
rolled AS (SELECT source_id, image_id, "row", col, coalesce(ta, attribute_id) AS attribute_id,
  coalesce(tf, form_id) AS form_id FROM mapped LEFT JOIN rules ON attribute_id = fa AND form_id = ff),
final AS (SELECT attribute_id, form_id, source_id, count(*) OVER (PARTITION BY attribute_id, form_id) AS n
  FROM rolled WHERE NOT (attribute_id = 'PROMO' AND form_id = ''))"""


@query(
    "dataset_build",
    f"""WITH {BUILD}, sized AS (SELECT attribute_id, form_id, count(*) AS n, count(DISTINCT source_id) AS s,
          CAST(floor(count(*) * 0.1) AS BIGINT) AS r FROM final GROUP BY 1, 2)
        SELECT lower(attribute_id) AS attribute_name, CASE WHEN form_id = '' THEN '' ELSE 'f-' || form_id END AS form_name,
          s AS num_projects, n AS num_annotations, CASE WHEN r = 0 THEN 0 ELSE n - 2 * r END AS train,
          r AS ref, r AS val, CASE WHEN r = 0 THEN n ELSE 0 END AS dropped, attribute_id, form_id FROM sized""",
)
def _(spark, sf):
    return _build(spark, sf).tables["class_counts"]


@query(
    "dataset_build_tables",
    f"""WITH {BUILD}, sized AS (SELECT attribute_id, form_id, count(*) AS n FROM final GROUP BY 1, 2)
        SELECT 'included_sources' AS name, count(DISTINCT source_id) AS rows FROM manifest
        UNION ALL SELECT 'project_stats_raw', count(DISTINCT source_id) FROM manifest
        UNION ALL SELECT 'label_mapping', count(*) FROM mapping
        UNION ALL SELECT 'unmapped_labels', count(DISTINCT label_id) FROM manifest
          WHERE CAST(label_id AS VARCHAR) NOT IN (SELECT provider_id FROM mapping)
        UNION ALL SELECT 'rollup_spec', count(*) FROM rules
        UNION ALL SELECT 'labels_excluded', 1
        UNION ALL SELECT 'retention', 1
        UNION ALL SELECT 'project_stats_train_data', count(DISTINCT source_id) FROM final
        UNION ALL SELECT 'attribute_counts', count(DISTINCT attribute_id) FROM final
        UNION ALL SELECT 'class_counts', count(*) FROM sized
        UNION ALL SELECT 'train_summary', 1
        UNION ALL SELECT 'annotations_val', CAST(sum(CAST(floor(n * 0.1) AS BIGINT)) AS BIGINT) FROM sized""",
)
def _(spark, sf):
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, df in _build(spark, sf).tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _build(spark, sf):
    root = _path(spark, "build")
    built = manifest.build_manifest(raw_annotations(spark, sf), raw_images(spark, sf))
    sinks.write_manifest(built, f"{root}/manifest")
    rules = spark.createDataFrame([("ECONOMY", "", "STANDARD", "")], ROLLUP_SCHEMA)
    sinks.write_rollups(rules, f"{root}/rollups")
    sinks.write_included(spark.createDataFrame([("PROMO", "")], LISTED_SCHEMA), f"{root}/excluded")
    options = DatasetOptions.from_dict(
        {
            "manifest_path": f"{root}/manifest",
            "rollup_csv": f"{root}/rollups",
            "excluded_csv": f"{root}/excluded",
        }
    )
    return build_dataset(spark, options, label_mapping(spark, sf), None, _type_names(spark, sf), _brands(spark, sf))


def _brands(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("id")).distinct()
    return brands.withColumn("name", F.concat(F.lit("f-"), "id"))


# All parts of the build at once: both sites, forms cleared, a rollup, a list of classes to keep, a balanced subsample, a listing that
# lacks every image whose number is a multiple of 50, the split, the weights and the rows of one source.
WHOLE = f"""{MANIFEST}, {MAPPING}, {NATIVE},
points AS (SELECT 'archive' AS site, CAST(source_id AS VARCHAR) AS project_id, CAST(image_id AS VARCHAR) AS image_id, "row", col, attribute_id
  FROM manifest JOIN mapping ON CAST(label_id AS VARCHAR) = provider_id
  UNION ALL SELECT site, project_id, image_id, "row", col, attribute_id FROM native),
rolled AS (SELECT * REPLACE (CASE attribute_id WHEN 'ECONOMY' THEN 'STANDARD' ELSE attribute_id END AS attribute_id) FROM points),
kept AS (SELECT * FROM rolled WHERE attribute_id IN ('STANDARD', 'MEDIUM', 'LARGE')),
sizes AS (SELECT attribute_id, count(*) AS n FROM kept GROUP BY 1),
budget AS (SELECT attribute_id, n, least(n, greatest(100, (SELECT count(*) FROM lineitem) // 10 // (SELECT count(*) FROM sizes))) AS target_n FROM sizes),
numbered AS (SELECT k.*, target_n, row_number() OVER (PARTITION BY attribute_id ORDER BY site, project_id, image_id, "row", col) AS rn
  FROM kept k JOIN budget USING (attribute_id)),
cut AS (SELECT * FROM numbered WHERE rn <= target_n),
here AS (SELECT * FROM cut WHERE CAST(image_id AS BIGINT) % 50 <> 0),
final AS (SELECT attribute_id, count(*) AS n, count(DISTINCT project_id) AS s, CAST(floor(count(*) * 0.2) AS BIGINT) AS r,
  CAST(floor(count(*) * 0.1) AS BIGINT) AS v FROM here GROUP BY 1)"""


def _whole(spark, sf):
    root = _path(spark, "build")
    built = manifest.build_manifest(raw_annotations(spark, sf), raw_images(spark, sf))
    sinks.write_manifest(built, f"{root}/manifest")
    _native(spark, sf).write.parquet(f"{root}/native")
    rules = spark.createDataFrame([("ECONOMY", "", "STANDARD", "")], ROLLUP_SCHEMA)
    sinks.write_rollups(rules, f"{root}/rollups")
    listed = [("STANDARD", ""), ("MEDIUM", ""), ("LARGE", "")]
    sinks.write_included(spark.createDataFrame(listed, LISTED_SCHEMA), f"{root}/included")
    options = DatasetOptions.from_dict(
        {
            "manifest_path": f"{root}/manifest",
            "provider_site": "archive",
            "native_path": f"{root}/native",
            "drop_forms": True,
            "rollup_csv": f"{root}/rollups",
            "included_csv": f"{root}/included",
            "subsample": {"strategy": "balanced", "total_annotations": table(spark, sf, "lineitem").count() // 10, "min_per_class": 100},
            "weighting": {"weight_ratio_cap": 20.0},
            "ref_val_ratios": ("0.2", "0.1"),
            "percent_missing_allowed": 10,
            "annotations_to_log": "s1",
        }
    )
    line = table(spark, sf, "lineitem").where("l_orderkey % 50 <> 0").select("l_suppkey", "l_orderkey")
    provider = keys.provider_feature_path(F.col("l_suppkey"), F.col("l_orderkey"))
    listing = tables.all_listings(
        line.select(F.concat(F.lit("features/"), provider).alias("feature_full")),
        line.select(F.concat(F.lit("native-features/native/"), "l_orderkey", F.lit("_featurevector")).alias("feature_full")),
    )
    return build_dataset(spark, options, label_mapping(spark, sf), listing, _type_names(spark, sf), _brands(spark, sf))


@query(
    "whole_build",
    f"""WITH {WHOLE} SELECT lower(attribute_id) AS attribute_name, '' AS form_name, s AS num_projects, n AS num_annotations,
          CASE WHEN v = 0 THEN 0 ELSE n - r - v END AS train, CASE WHEN v = 0 THEN 0 ELSE r END AS ref, v AS val,
          CASE WHEN v = 0 THEN n ELSE 0 END AS dropped, attribute_id, '' AS form_id FROM final""",
)
def _(spark, sf):
    return _whole(spark, sf).tables["class_counts"]


@query(
    "whole_build_weights",
    f"""WITH {WHOLE}, w AS (SELECT attribute_id, n - r - v AS n,
            1.0 / ((1.0 - pow(0.9999, CAST(n - r - v AS DOUBLE))) / (1.0 - 0.9999)) AS weight FROM final WHERE v > 0)
        SELECT attribute_id || '::' AS class_key, attribute_id, lower(attribute_id) AS attribute_name, '' AS form_id, '' AS form_name,
          n AS count, {q('least(weight, (SELECT min(weight) FROM w) * 20)', 9)} AS weight FROM w""",
)
def _(spark, sf):
    return tidy(_whole(spark, sf).tables["class_weights"], 9)


@query(
    "whole_build_retention",
    f"""WITH {WHOLE}, b AS (SELECT count(*) AS a, count(DISTINCT site || project_id || '/' || image_id) AS i FROM points),
          f AS (SELECT count(*) AS a, count(DISTINCT site || project_id || '/' || image_id) AS i FROM kept)
        SELECT b.a AS annotations_before, b.a AS annotations_rollup, f.a AS annotations_filter, b.i AS images_before,
          b.i AS images_rollup, f.i AS images_filter, CAST(0 AS BIGINT) AS annotations_lost_rollup,
          b.a - f.a AS annotations_lost_filter, {q('100.0 * f.a / b.a')} AS annotations_kept_pct,
          CAST(0 AS BIGINT) AS images_lost_rollup, b.i - f.i AS images_lost_filter, {q('100.0 * f.i / b.i')} AS images_kept_pct
        FROM b, f""",
)
def _(spark, sf):
    return tidy(_whole(spark, sf).tables["retention"])


@query(
    "whole_build_audit",
    f"""WITH {WHOLE} SELECT attribute_id, lower(attribute_id) AS attribute_name, '' AS form_id, '' AS form_name, n AS pre_count,
          CAST(target_n AS BIGINT) AS target_n, CAST(target_n AS BIGINT) AS realized_n FROM budget""",
)
def _(spark, sf):
    return _whole(spark, sf).tables["subsample_audit"]


@query(
    "whole_build_source_log",
    f"""WITH {WHOLE} SELECT image_id, "row", col, attribute_id FROM here WHERE site = 'archive' AND project_id = '1'""",
)
def _(spark, sf):
    return _whole(spark, sf).tables["annotations_s1"].select("image_id", "row", "col", "attribute_id")
