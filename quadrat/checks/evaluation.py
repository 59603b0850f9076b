"""Queries on taxonomy, evaluation and run logs, with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrat.checks.bindings import (
    CELLS,
    CLOSURE,
    NODES,
    PREDICTION_KEY,
    PREDS,
    PROBS,
    RANKS,
    nation_classes,
    nation_walk,
    nodes,
    predictions,
    prob_classes,
    probs,
    q,
    table,
    text,
    tidy,
)
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

from quadrat.operators import rollup_builder, runs, taxonomy
from quadrat.operators.staging import pin, stage, staging_root
from quadrat.plans import evaluate as plan
from quadrat.sources import sinks, specs

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# --- taxonomy ---------------------------------------------------------------------------------

WALKED = f"""{CLOSURE}, walked AS (
  SELECT n.id, n.name, n.parent, string_agg(c.ancestor, '/' ORDER BY c.distance DESC) AS path,
         arg_max(c.ancestor, c.distance) AS root, count(*) AS depth
  FROM nodes n JOIN closure c ON n.id = c.id GROUP BY n.id, n.name, n.parent)"""


def _walked(spark, sf):
    return taxonomy.paths(nodes(spark, sf))


@query("taxonomy_paths", f"WITH {WALKED} SELECT id, name, parent, path, root FROM walked")
def _(spark, sf):
    return _walked(spark, sf).withColumn("path", F.array_join("path", "/"))


@query(
    "taxonomy_ancestors",
    f"""WITH {CLOSURE}, d AS (SELECT id, max(distance) AS top FROM closure GROUP BY id)
        SELECT c.id, CAST(top - distance AS INTEGER) AS position, ancestor FROM closure c JOIN d ON c.id = d.id
        WHERE distance > 0""",
)
def _(spark, sf):
    return taxonomy.ancestors(_walked(spark, sf))


@query(
    "taxonomy_descendants",
    f"""WITH {CLOSURE} SELECT ancestor, c.id, name, parent, CAST(distance AS INTEGER) AS distance
        FROM closure c JOIN nodes n ON c.id = n.id WHERE distance > 0""",
)
def _(spark, sf):
    return taxonomy.descendants(_walked(spark, sf))


@query("taxonomy_closure", f"WITH {CLOSURE} SELECT id, ancestor, CAST(distance AS INTEGER) AS distance FROM closure")
def _(spark, sf):
    return taxonomy.closure(_walked(spark, sf))


@query(
    "taxonomy_roots",
    f"""WITH {WALKED} SELECT w.id, w.root, n.name AS root_name FROM walked w JOIN nodes n ON w.root = n.id""",
)
def _(spark, sf):
    return taxonomy.roots(_walked(spark, sf))


# Common ancestors of the supplier and the customer's nation of each order line.
PAIRS = f"""{PREDS}, pairs AS (SELECT 's' || l_suppkey AS a, est_attr AS b, count(*) AS n FROM preds GROUP BY 1, 2),
{CLOSURE},
common AS (SELECT a, b, x.ancestor, x.distance AS da FROM pairs JOIN closure x ON x.id = a
  JOIN closure y ON y.id = b AND y.ancestor = x.ancestor),
depths AS (SELECT id, count(*) AS depth FROM closure GROUP BY id)"""


@query(
    "taxonomy_lca",
    f"""WITH {PAIRS} SELECT p.a, p.b, arg_min(c.ancestor, c.da) AS lca,
        {q('count(c.ancestor) / CAST(greatest(any_value(d.depth), any_value(e.depth)) AS DOUBLE)')} AS similarity,
        any_value(p.n) AS n
        FROM pairs p LEFT JOIN common c ON p.a = c.a AND p.b = c.b
        JOIN depths d ON d.id = p.a JOIN depths e ON e.id = p.b GROUP BY p.a, p.b""",
)
def _(spark, sf):
    pairs = (
        predictions(spark, sf)
        .groupBy(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.split("est", "::")[0].alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    walked = _walked(spark, sf).select("id", "path")
    a = walked.select(F.col("id").alias("a"), F.col("path").alias("pa"))
    b = walked.select(F.col("id").alias("b"), F.col("path").alias("pb"))
    return tidy(
        pairs.join(a, "a")
        .join(b, "b")
        .select(
            "a",
            "b",
            taxonomy.lca(F.col("pa"), F.col("pb")).alias("lca"),
            taxonomy.similarity(F.col("pa"), F.col("pb")).alias("similarity"),
            "n",
        )
    )


@query(
    "samples_by_root",
    f"""WITH {CELLS} SELECT root, root_name AS category, avg(l_quantity) AS mean_quantity, count(*) AS n_samples
        FROM preds JOIN classes ON gt = class_id GROUP BY root, root_name HAVING count(*) >= 30""",
)
def _(spark, sf):
    return taxonomy.by_root(
        predictions(spark, sf), nation_classes(spark, sf), F.avg("l_quantity").alias("mean_quantity")
    )


@query(
    "taxonomy_unresolved_names",
    f"""WITH {NODES} SELECT name FROM (SELECT n_name AS name FROM nation UNION ALL
        SELECT c_name FROM customer) x ANTI JOIN nodes USING (name)""",
)
def _(spark, sf):
    named = table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(
        table(spark, sf, "customer").select("c_name")
    )
    return taxonomy.unresolved_names(named, nodes(spark, sf))


# --- building a rollup --------------------------------------------------------------------------

FORMS = [("f1", "Branching"), ("f2", "Massive"), ("f3", "Encrusting")]
BARRED = ("NATION_3", "NATION_4")
DESIGNATED = "n5"
BUILDER = f"""{CLOSURE},
forms AS (SELECT * FROM (VALUES ('f1', 'Branching'), ('f2', 'Massive'), ('f3', 'Encrusting')) f(id, name)),
flagged AS (SELECT n_name AS name FROM nation WHERE n_regionkey <> 1 AND n_nationkey <> 10
            UNION ALL SELECT r_name FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'NOWHERE'),
targets AS (SELECT id FROM nodes SEMI JOIN flagged USING (name) WHERE name NOT IN ('NATION_3', 'NATION_4')),
barred AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal BETWEEN 8000 AND 8500
           UNION ALL SELECT id FROM nodes WHERE name IN ('NATION_3', 'NATION_4')),
entries AS (
  SELECT 'p' || s_suppkey AS provider_id,
         CASE WHEN s_acctbal > 9500 THEN NULL WHEN s_acctbal > 9000 THEN 'x' || s_suppkey
              ELSE 's' || s_suppkey END AS a,
         CASE WHEN s_acctbal < 2000 THEN '' WHEN s_acctbal < 4000 THEN 'f1' WHEN s_acctbal < 6000 THEN 'f2'
              ELSE 'f3' END AS f FROM supplier
  UNION ALL SELECT 'q' || n_nationkey, 'n' || n_nationkey, 'f1' FROM nation),
inherent AS (SELECT 's' || s_suppkey AS id, 'Massive' AS inherent FROM supplier WHERE s_acctbal < 1000),
nearest AS (SELECT c.id, arg_min(ancestor, distance) AS target FROM closure c
            JOIN targets t ON c.ancestor = t.id GROUP BY c.id),
joined AS (
  SELECT provider_id, a, f, target, inherent, fm.name AS fname,
         CASE WHEN a IS NULL THEN 'null' WHEN a IN (SELECT id FROM barred) THEN 'excluded'
              WHEN a NOT IN (SELECT id FROM nodes) THEN 'unknown' WHEN target IS NULL THEN 'no_target' END AS reason
  FROM entries LEFT JOIN nearest n ON a = n.id LEFT JOIN inherent i ON a = i.id LEFT JOIN forms fm ON f = fm.id),
named AS (
  SELECT *, CASE WHEN target <> '{DESIGNATED}' THEN '' WHEN f <> '' THEN
              CASE WHEN fname IN ('Branching', 'Massive') THEN fname ELSE '' END
              WHEN a = '{DESIGNATED}' THEN '' ELSE coalesce(inherent, '') END AS kept FROM joined),
classified AS (
  SELECT provider_id, a AS attribute_id, f AS form_id, reason,
         CASE WHEN reason IS NULL THEN target END AS to_attribute_id,
         CASE WHEN reason IS NULL THEN CASE kept WHEN 'Branching' THEN 'f1' WHEN 'Massive' THEN 'f2' ELSE '' END
           END AS to_form_id,
         CASE WHEN reason IS NULL THEN kept END AS to_form_name FROM named),
rolls AS (
  SELECT DISTINCT attribute_id AS from_attribute_id, form_id AS from_form_id, to_attribute_id, to_form_id, to_form_name
  FROM classified WHERE reason IS NULL AND NOT (attribute_id = to_attribute_id AND form_id = to_form_id)),
included AS (
  SELECT id AS attribute_id, '' AS form_id FROM targets
  UNION ALL SELECT id, f FROM targets, (VALUES ('f1'), ('f2')) v(f) WHERE id = '{DESIGNATED}')"""


def _labels(spark, sf):
    """The label list: nations and one region are flagged, some names are unknown."""
    nation = table(spark, sf, "nation").select(
        F.col("n_name").alias("name"),
        F.when((F.col("n_regionkey") != 1) & (F.col("n_nationkey") != 10), 1).alias("top100"),
    )
    region = table(spark, sf, "region").select(
        F.col("r_name"), F.when(F.col("r_regionkey") == 0, 1).otherwise(0)
    )
    return nation.union(region).union(spark.createDataFrame([("NOWHERE", 1)], "name string, top100 int"))


def _targets(spark, sf):
    flagged = rollup_builder.flagged_names(_labels(spark, sf))
    return rollup_builder.resolve_targets(flagged, nodes(spark, sf), BARRED)


def _forms(spark):
    return spark.createDataFrame(FORMS, "id string, name string")


def _classified(spark, sf):
    supplier = table(spark, sf, "supplier")
    attribute = F.when(F.col("s_acctbal") > 9500, F.lit(None)).otherwise(
        F.concat(F.when(F.col("s_acctbal") > 9000, "x").otherwise("s"), "s_suppkey")
    )
    form = (
        F.when(F.col("s_acctbal") < 4000, "f1").when(F.col("s_acctbal") < 6000, "f2").otherwise("f3")
    )
    entries = supplier.select(
        F.concat(F.lit("p"), "s_suppkey").alias("provider_id"),
        attribute.alias("attribute_id"),
        F.when(F.col("s_acctbal") >= 2000, form).alias("form_id"),
    ).union(
        table(spark, sf, "nation").select(
            F.concat(F.lit("q"), "n_nationkey"), F.concat(F.lit("n"), "n_nationkey"), F.lit("f1")
        )
    )
    barred = supplier.where("s_acctbal BETWEEN 8000 AND 8500").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id")
    )
    listed = supplier.where("s_acctbal < 1500").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"),
        F.when(F.col("s_acctbal") < 1000, "massive").otherwise("branching, massive").alias("growth forms"),
    )
    return rollup_builder.classify_mapping(
        entries,
        _walked(spark, sf),
        _forms(spark),
        _targets(spark, sf)[0],
        barred.union(rollup_builder.excluded_ids(nodes(spark, sf), BARRED)),
        DESIGNATED,
        rollup_builder.inherent_forms(listed),
    )


@query("target_classes", f"WITH {BUILDER} SELECT id FROM targets")
def _(spark, sf):
    return _targets(spark, sf)[0]


@query(
    "target_names_left_out",
    f"""WITH {BUILDER} SELECT name, 'unresolved' AS why FROM flagged ANTI JOIN nodes USING (name)
        UNION ALL SELECT name, 'excluded' FROM flagged WHERE name IN ('NATION_3', 'NATION_4')""",
)
def _(spark, sf):
    _, unresolved, excluded = _targets(spark, sf)
    return unresolved.withColumn("why", F.lit("unresolved")).union(
        excluded.withColumn("why", F.lit("excluded"))
    )


@query("nearest_target_ancestors", f"WITH {BUILDER} SELECT id, target FROM nearest")
def _(spark, sf):
    return rollup_builder.nearest_targets(_walked(spark, sf), _targets(spark, sf)[0])


@query("rollup_mapping_classified", f"WITH {BUILDER} SELECT * FROM classified")
def _(spark, sf):
    return _classified(spark, sf)


@query("rollup_rows_built", f"WITH {BUILDER} SELECT * FROM rolls")
def _(spark, sf):
    return rollup_builder.rollup_rows(_classified(spark, sf))


@query(
    "rollup_drop_reasons",
    f"WITH {BUILDER} SELECT reason, count(*) AS entries FROM classified WHERE reason IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    return rollup_builder.drop_reasons(_classified(spark, sf))


@query(
    "rollup_breakdown",
    f"""WITH {BUILDER}, x AS (SELECT *, from_attribute_id = to_attribute_id AS stays,
          to_attribute_id = '{DESIGNATED}' AS special FROM rolls)
        SELECT count(*) FILTER (WHERE stays) AS form_collapse, count(*) FILTER (WHERE NOT stays) AS cross_attribute,
          count(*) FILTER (WHERE special AND stays) AS designated_form_collapse,
          count(*) FILTER (WHERE special AND NOT stays AND to_form_name = 'Branching') AS designated_to_branching,
          count(*) FILTER (WHERE special AND NOT stays AND to_form_name = 'Massive') AS designated_to_massive,
          count(*) FILTER (WHERE special AND NOT stays AND to_form_name = '') AS designated_to_other FROM x""",
)
def _(spark, sf):
    return rollup_builder.rollup_breakdown(rollup_builder.rollup_rows(_classified(spark, sf)), DESIGNATED)


@query("included_classes_built", f"WITH {BUILDER} SELECT * FROM included")
def _(spark, sf):
    return rollup_builder.included_rows(_targets(spark, sf)[0], _forms(spark), DESIGNATED)


@query(
    "rollup_targets_outside",
    f"""WITH {BUILDER} SELECT to_attribute_id, from_attribute_id, from_form_id, to_form_id, to_form_name FROM rolls
        ANTI JOIN (SELECT attribute_id AS to_attribute_id FROM included WHERE attribute_id <> '{DESIGNATED}') i
        USING (to_attribute_id)""",
)
def _(spark, sf):
    included = rollup_builder.included_rows(_targets(spark, sf)[0], _forms(spark), DESIGNATED)
    return rollup_builder.rows_outside(
        rollup_builder.rollup_rows(_classified(spark, sf)), included.where(F.col("attribute_id") != DESIGNATED)
    )


@query(
    "rollup_spec_csv",
    f"WITH {BUILDER} SELECT from_attribute_id, from_form_id, to_attribute_id, to_form_id FROM rolls",
)
def _(spark, sf):
    path = f"{staging_root(spark)}/rollups-{uuid.uuid4().hex}"
    sinks.write_rollups(rollup_builder.rollup_rows(_classified(spark, sf)), path)
    return specs.load_rollup(spark, path)


@query("included_spec_csv", f"WITH {BUILDER} SELECT * FROM included")
def _(spark, sf):
    path = f"{staging_root(spark)}/included-{uuid.uuid4().hex}"
    sinks.write_included(
        rollup_builder.included_rows(_targets(spark, sf)[0], _forms(spark), DESIGNATED), path
    )
    return specs.load_filter(spark, path)


# --- confusion and classification ---------------------------------------------------------------

FULL = f"""{CELLS}, full_cells AS (
  SELECT a.class_id AS gt, b.class_id AS est, coalesce(n, 0) AS n FROM classes a CROSS JOIN classes b
  LEFT JOIN cells c ON c.gt = a.class_id AND c.est = b.class_id),
pct_cells AS (
  SELECT *, coalesce(CAST(floor(100 * n / nullif(CAST(sum(n) OVER (PARTITION BY gt) AS DOUBLE), 0)) AS BIGINT), 0) AS pct
  FROM full_cells)"""


def _cells(spark, sf):
    return confusion.confusion(predictions(spark, sf))


@query("confusion_cells", f"WITH {CELLS} SELECT * FROM cells")
def _(spark, sf):
    return _cells(spark, sf)


@query("confusion_matrix", f"WITH {FULL} SELECT * FROM pct_cells")
def _(spark, sf):
    return confusion.full_confusion(_cells(spark, sf), nation_classes(spark, sf))


# The class keys and display names follow from the 25 nations and three forms.
_WIDE = ", ".join(
    f"""max(CASE WHEN est = 'n{n}::{form}' THEN n END) AS "NATION_{n}{shown}\""""
    for n in range(25)
    for form, shown in (("", ""), ("A", "::Arm"), ("R", "::Round"))
)


@query(
    "confusion_wide",
    f"""WITH {FULL}, named AS (SELECT a.class_name AS "-", est, n FROM full_cells JOIN classes a ON gt = a.class_id)
        SELECT "-", {_WIDE} FROM named GROUP BY 1""",
)
def _(spark, sf):
    classes = nation_classes(spark, sf)
    return confusion.wide_confusion(confusion.full_confusion(_cells(spark, sf), classes), classes)


@query(
    "profile_distances",
    f"""WITH {CELLS}, share AS (SELECT gt, est, n / CAST(sum(n) OVER (PARTITION BY gt) AS DOUBLE) AS s FROM cells),
        norms AS (SELECT gt, sqrt(sum(s * s)) AS norm FROM share GROUP BY gt),
        dots AS (SELECT a.gt AS ga, b.gt AS gb, sum(a.s * b.s) AS dot FROM share a JOIN share b USING (est)
                 WHERE a.gt < b.gt GROUP BY 1, 2)
        SELECT x.class_id AS gt_a, y.class_id AS gt_b, {q('1 - coalesce(dot / (m.norm * o.norm), 0)')} AS distance
        FROM classes x JOIN classes y ON x.class_id < y.class_id
        LEFT JOIN dots ON ga = x.class_id AND gb = y.class_id
        LEFT JOIN norms m ON m.gt = x.class_id LEFT JOIN norms o ON o.gt = y.class_id""",
)
def _(spark, sf):
    return tidy(confusion.profile_distances(_cells(spark, sf), nation_classes(spark, sf)))


PER_LABEL = f"""SELECT class_name, {q('coalesce("precision", 0)')} AS "precision", {q('coalesce(recall, 0)')} AS recall,
  {q('coalesce(f1, 0)')} AS f1_score, coalesce(support, 0) AS n_samples, class_id
  FROM classes LEFT JOIN scores ON class_id = label"""


@query("label_scores", f"WITH {CELLS} {PER_LABEL}")
def _(spark, sf):
    return tidy(classification.per_label(_cells(spark, sf), nation_classes(spark, sf)))


@query("label_scores_for_review", f"WITH {CELLS} {PER_LABEL} ORDER BY f1_score, class_id")
def _(spark, sf):
    return tidy(
        runs.labels_for_review(classification.per_label(_cells(spark, sf), nation_classes(spark, sf)))
    )


OVERALL = """macro AS (SELECT avg("precision") AS p, avg(recall) AS r, avg(recall) FILTER (WHERE support > 0) AS b,
  sum(CAST(support AS DOUBLE)) AS s, sum(CAST(correct AS DOUBLE)) AS c,
  sum(CAST(predicted AS DOUBLE) * support) AS pt, sum(CAST(predicted AS DOUBLE) * predicted) AS pp,
  sum(CAST(support AS DOUBLE) * support) AS tt FROM scores)"""


@query(
    "overall_scores",
    f"""WITH {CELLS}, {OVERALL} SELECT {q('p')} AS precision_macro, {q('r')} AS recall_macro,
        {q('b')} AS balanced_accuracy, {q('(c * s - pt) / sqrt((s * s - pp) * (s * s - tt))')} AS mcc,
        {q('c / s')} AS accuracy, {q('2 * p * r / (p + r)')} AS f1_macro FROM macro""",
)
def _(spark, sf):
    return tidy(classification.overall(_cells(spark, sf)))


@query(
    "accuracy_by_model",
    f"""WITH {PREDS} SELECT o_orderpriority AS model_id,
        {q('avg(CASE WHEN gt_attr = est_attr THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n
        FROM preds JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(spark, sf):
    preds = predictions(spark, sf).select(
        "l_orderkey", F.split("gt", "::")[0].alias("gt"), F.split("est", "::")[0].alias("est")
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("model_id")
    )
    return tidy(classification.accuracy_by(preds.join(orders, "l_orderkey")))


# --- taxonomy errors ----------------------------------------------------------------------------

ERRORS = f"""{CELLS}, wrong AS (
  SELECT n, a.root AS gt_root, CASE WHEN a.attribute_id = b.attribute_id THEN a.attribute_id
           WHEN a.root = b.root THEN a.root END AS lca
  FROM cells JOIN classes a ON gt = a.class_id JOIN classes b ON est = b.class_id WHERE gt <> est),
byl AS (SELECT lca, CAST(sum(n) AS BIGINT) AS error_count FROM wrong GROUP BY lca),
attributed AS (
  SELECT coalesce(lca, '(cross-branch)') AS lca_node, coalesce(n_name, r.r_name, '(cross-branch)') AS lca_name,
         coalesce(nr.r_name, r.r_name, '') AS branch, error_count,
         error_count / (SELECT CAST(sum(n) AS DOUBLE) FROM wrong) * 100 AS pct,
         CASE WHEN lca IS NULL THEN 0 WHEN n_name IS NOT NULL THEN 1
              ELSE (SELECT count(*) FROM nation x WHERE 'r' || x.n_regionkey = lca) END AS classes_in_subtree
  FROM byl LEFT JOIN nation ON lca = 'n' || n_nationkey LEFT JOIN region nr ON n_regionkey = nr.r_regionkey
       LEFT JOIN region r ON lca = 'r' || r.r_regionkey)"""


@query(
    "branch_error_rates",
    f"""WITH {ERRORS} SELECT {q('sum(n) FILTER (WHERE lca IS NULL) / CAST(sum(n) AS DOUBLE)')} AS cross_branch_error_rate,
        {q('sum(n) FILTER (WHERE lca IS NOT NULL) / CAST(sum(n) AS DOUBLE)')} AS within_branch_error_rate FROM wrong""",
)
def _(spark, sf):
    return tidy(hierarchy.branch_error_rates(_cells(spark, sf), nation_classes(spark, sf)))


def _attributed(spark, sf):
    return hierarchy.error_attribution(
        _cells(spark, sf), nation_classes(spark, sf), nation_walk(spark, sf)
    )


@query(
    "error_attribution",
    f"""WITH {ERRORS} SELECT lca_node, lca_name, branch, error_count, {q('pct')} AS pct_of_errors,
        classes_in_subtree FROM attributed""",
)
def _(spark, sf):
    return tidy(_attributed(spark, sf))


@query(
    "branch_errors",
    f"""WITH {ERRORS}, b AS (SELECT CASE WHEN lca_node = '(cross-branch)' THEN lca_node ELSE branch END AS branch,
          CAST(sum(error_count) AS BIGINT) AS error_count FROM attributed GROUP BY 1)
        SELECT branch, error_count, {q('error_count / CAST(sum(error_count) OVER () AS DOUBLE)')} AS share FROM b""",
)
def _(spark, sf):
    return tidy(hierarchy.branch_errors(_attributed(spark, sf)))


@query(
    "top_error_ancestors",
    f"""WITH {ERRORS} SELECT lca_node, lca_name, branch, error_count, {q('pct')} AS pct_of_errors,
        classes_in_subtree FROM attributed ORDER BY error_count DESC, lca_node LIMIT 15""",
)
def _(spark, sf):
    return tidy(hierarchy.top_lca(_attributed(spark, sf)))


ROOTS = f"""{CELLS}, rolled AS (
  SELECT a.root AS gt_root, a.root_name AS gt_name, b.root AS est_root, b.root_name AS est_name,
         CAST(sum(n) AS BIGINT) AS sample_count
  FROM cells JOIN classes a ON gt = a.class_id JOIN classes b ON est = b.class_id GROUP BY 1, 2, 3, 4),
pcts AS (SELECT *, CAST(floor(100 * sample_count / CAST(sum(sample_count) OVER (PARTITION BY gt_root) AS DOUBLE))
  AS BIGINT) AS row_normalized_pct FROM rolled)"""


def _rolled(spark, sf):
    return hierarchy.root_confusion(_cells(spark, sf), nation_classes(spark, sf))


@query(
    "root_confusion",
    f"""WITH {ROOTS} SELECT gt_root, gt_name AS "true", est_root, est_name AS predicted, sample_count,
        row_normalized_pct FROM pcts""",
)
def _(spark, sf):
    return _rolled(spark, sf)


@query(
    "root_confusions_listed",
    f"""WITH {ROOTS} SELECT gt_name AS "true", est_name AS predicted, row_normalized_pct, sample_count FROM pcts
        WHERE gt_root <> est_root""",
)
def _(spark, sf):
    return hierarchy.root_confusions(_rolled(spark, sf))


@query(
    "root_order",
    f"""WITH {ROOTS}, t AS (SELECT root, name, CAST(sum(t) AS BIGINT) AS support FROM (
          SELECT gt_root AS root, gt_name AS name, sample_count AS t FROM rolled
          UNION ALL SELECT est_root, est_name, 0 FROM rolled) u GROUP BY 1, 2)
        SELECT root, name, support, CAST(row_number() OVER (ORDER BY support DESC, root) AS INTEGER) AS position FROM t""",
)
def _(spark, sf):
    return hierarchy.root_order(_rolled(spark, sf))


@query(
    "roots_only_predicted",
    f"""WITH {ROOTS} SELECT DISTINCT est_root AS root FROM rolled WHERE est_root NOT IN (SELECT gt_root FROM rolled)
        UNION ALL SELECT 'of ' || g.gt_root || ': ' || e.est_root FROM (SELECT DISTINCT gt_root FROM rolled) g
          JOIN (SELECT DISTINCT gt_root, est_root FROM rolled) e USING (gt_root) WHERE e.est_root <> g.gt_root""",
)
def _(spark, sf):
    # Over the whole table every root is somewhere true; so each true root is also looked at for itself.
    rolled = pin(_rolled(spark, sf))
    out = hierarchy.only_predicted(rolled)
    for r in sorted(row[0] for row in rolled.select("gt_root").distinct().collect()):
        alone = hierarchy.only_predicted(rolled.where(F.col("gt_root") == r))
        out = out.unionByName(alone.select(F.concat(F.lit(f"of {r}: "), "root").alias("root")))
    return out


# --- forms --------------------------------------------------------------------------------------

FORMED = f"""{CELLS}, formed AS (
  SELECT a.form_name AS gt_form, CASE WHEN b.form_id = '' THEN '(no GF)' ELSE b.form_name END AS est_form,
         a.attribute_id = b.attribute_id AS same, n
  FROM cells JOIN classes a ON gt = a.class_id JOIN classes b ON est = b.class_id WHERE a.form_id <> ''),
fcells AS (SELECT gt_form, est_form, CAST(sum(n) AS BIGINT) AS n FROM formed GROUP BY 1, 2),
fsides AS (SELECT g.f, support, coalesce(predicted, 0) AS predicted, coalesce(correct, 0) AS correct
  FROM (SELECT gt_form AS f, CAST(sum(n) AS BIGINT) AS support FROM fcells GROUP BY 1) g
  LEFT JOIN (SELECT est_form AS f, sum(n) AS predicted FROM fcells GROUP BY 1) e ON g.f = e.f
  LEFT JOIN (SELECT gt_form AS f, n AS correct FROM fcells WHERE gt_form = est_form) c ON g.f = c.f)"""


def _formed(spark, sf):
    return forms.form_cells(_cells(spark, sf), nation_classes(spark, sf))


@query(
    "form_accuracy",
    f"""WITH {FORMED} SELECT
        {q('sum(n) FILTER (WHERE gt_form = est_form) / CAST(sum(n) AS DOUBLE)')} AS gf_accuracy_gf_relevant,
        {q('sum(n) FILTER (WHERE same AND gt_form = est_form) / CAST(sum(n) FILTER (WHERE same) AS DOUBLE)')}
          AS within_ba_gf_accuracy FROM formed""",
)
def _(spark, sf):
    return tidy(forms.form_accuracy(_formed(spark, sf)))


@query(
    "form_scores",
    f"""WITH {FORMED} SELECT f AS growth_form, round_even(CAST(correct AS DOUBLE) / predicted, 3) AS "precision",
        round_even(CAST(correct AS DOUBLE) / support, 3) AS recall,
        round_even(2.0 * correct / (CAST(predicted AS DOUBLE) + support), 3) AS f1, support FROM fsides""",
)
def _(spark, sf):
    return forms.form_scores(_formed(spark, sf))


@query(
    "form_confusion",
    f"""WITH {FORMED} SELECT gt_form AS gt, est_form AS est, n,
        CAST(floor(100 * n / CAST(sum(n) OVER (PARTITION BY gt_form) AS DOUBLE)) AS BIGINT) AS pct FROM fcells
        WHERE est_form = '(no GF)' OR est_form IN (SELECT gt_form FROM fcells)""",
)
def _(spark, sf):
    return forms.form_confusion(_formed(spark, sf))


# --- calibration --------------------------------------------------------------------------------

_ORDER = "score, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"
BINS = f"""{PREDS}, numbered AS (
  SELECT score, CASE WHEN gt = est THEN 1 ELSE 0 END AS hit,
         row_number() OVER (ORDER BY {_ORDER}) AS rn, count(*) OVER () AS n FROM preds),
bins AS (SELECT (rn * 20 - 1) // n AS b, count(*) AS cnt, sum(score) AS ss, sum(hit) AS hs,
  min(score) AS lo, max(score) AS hi FROM numbered GROUP BY 1)"""


def _bins(spark, sf):
    rows = calibration.scored_rows(predictions(spark, sf, scored=True), PREDICTION_KEY)
    return calibration.equal_mass_bins(rows, F.lit(calibration.N_BINS))


@query("calibration_error", f"WITH {BINS} SELECT {q('sum(abs(hs - ss)) / sum(cnt)')} AS ece FROM bins")
def _(spark, sf):
    return tidy(calibration.ece(_bins(spark, sf)))


@query(
    "calibration_bins",
    f"""WITH {BINS} SELECT CAST(row_number() OVER (ORDER BY b) AS INTEGER) AS bin, {q('lo')} AS conf_min,
        {q('hi')} AS conf_max, {q('ss / cnt')} AS avg_confidence, {q('CAST(hs AS DOUBLE) / cnt')} AS avg_accuracy,
        {q('ss / cnt - CAST(hs AS DOUBLE) / cnt')} AS gap, cnt AS count FROM bins""",
)
def _(spark, sf):
    return tidy(calibration.bin_table(_bins(spark, sf)))


@query(
    "calibration_by_category",
    f"""WITH {CELLS}, numbered AS (
          SELECT root_name AS category, score, CASE WHEN gt = est THEN 1 ELSE 0 END AS hit,
                 row_number() OVER (PARTITION BY root ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY root) AS n
          FROM preds JOIN classes ON gt = class_id),
        bins AS (SELECT category, (rn * least(20, greatest(2, n // 10)) - 1) // n AS b, count(*) AS cnt,
                   sum(score) AS ss, sum(hit) AS hs FROM numbered WHERE n >= 30 GROUP BY 1, 2)
        SELECT category, {q('sum(abs(hs - ss)) / sum(cnt)')} AS ece, {q('CAST(sum(hs) AS DOUBLE) / sum(cnt)')} AS accuracy,
               {q('sum(ss) / sum(cnt)')} AS avg_confidence, CAST(sum(cnt) AS BIGINT) AS n_samples
        FROM bins GROUP BY category""",
)
def _(spark, sf):
    rows = calibration.scored_rows(predictions(spark, sf, scored=True), PREDICTION_KEY, ["gt"])
    return tidy(calibration.category_ece(rows, nation_classes(spark, sf)))


# --- cover --------------------------------------------------------------------------------------

# The image is the order; its classes are nations with forms.
COVER = f"""{PREDS}, img AS (SELECT image_key, count(*) AS pts FROM preds GROUP BY 1),
num AS (SELECT count(*) AS n FROM img),
ic AS (SELECT image_key, class_id, sum(t) AS t, sum(p) AS p FROM (
    SELECT image_key, gt AS class_id, 1 AS t, 0 AS p FROM preds
    UNION ALL SELECT image_key, est, 0, 1 FROM preds) u GROUP BY 1, 2),
sh AS (SELECT class_id, t / CAST(pts AS DOUBLE) AS ts, p / CAST(pts AS DOUBLE) - t / CAST(pts AS DOUBLE) AS e
  FROM ic JOIN img USING (image_key)),
agg AS (SELECT class_id, sum(ts) AS t, sum(ts * ts) AS tt, sum(e) AS e, sum(e * e) AS ee, sum(abs(e)) AS ae,
  count(*) AS present, min(ts) AS lo, max(ts) AS hi FROM sh GROUP BY 1),
cover AS (SELECT class_id, t / n * 100 AS mean_true_cover_pct, e / n * 100 AS bias_pct, sqrt(ee / n) * 100 AS rmse_pct,
  ae / n * 100 AS mae_pct,
  CASE WHEN (CASE WHEN present < n THEN 0 ELSE lo END) = hi THEN CAST('NaN' AS DOUBLE)
       ELSE 1 - ee / (tt - t * t / n) END AS r_squared FROM agg, num)"""


@query(
    "cover_by_class",
    f"""WITH {COVER} SELECT class_id, {q('mean_true_cover_pct')} AS mean_true_cover_pct, {q('bias_pct')} AS bias_pct,
        {q('rmse_pct')} AS rmse_pct, {q('mae_pct')} AS mae_pct, {q('r_squared')} AS r_squared FROM cover""",
)
def _(spark, sf):
    return tidy(cover.cover_by_class(predictions(spark, sf)))


@query(
    "cover_scalars",
    f"""WITH {COVER} SELECT {q('avg(abs(bias_pct))')} AS cover_mean_abs_bias_pct, {q('avg(rmse_pct)')} AS cover_mean_rmse_pct,
        {q('avg(mae_pct)')} AS cover_mean_mae_pct,
        {q('median(r_squared) FILTER (WHERE NOT isnan(r_squared))')} AS cover_median_r_squared
        FROM cover WHERE mean_true_cover_pct > 0.5""",
)
def _(spark, sf):
    return tidy(cover.cover_scalars(cover.cover_by_class(predictions(spark, sf))))


@query(
    "cover_bias_view",
    f"""WITH {COVER} SELECT class_id, {q('mean_true_cover_pct')} AS mean_true_cover_pct, {q('bias_pct')} AS bias_pct
        FROM cover WHERE mean_true_cover_pct > 0.5 ORDER BY cover.mean_true_cover_pct DESC, class_id LIMIT 20""",
)
def _(spark, sf):
    return tidy(cover.bias_view(cover.cover_by_class(predictions(spark, sf))))


# --- per source ---------------------------------------------------------------------------------

PER_SOURCE = f"""{PREDS}, sc AS (SELECT source_key, gt, est, gt_attr, est_attr, count(*) AS n FROM preds GROUP BY ALL),
sl AS (SELECT source_key, label, sum(t) AS s, sum(p) AS p, sum(c) AS c FROM (
    SELECT source_key, gt AS label, n AS t, 0 AS p, CASE WHEN gt = est THEN n ELSE 0 END AS c FROM sc
    UNION ALL SELECT source_key, est, 0, n, 0 FROM sc) u GROUP BY 1, 2),
sm AS (SELECT source_key, CAST(sum(s) AS BIGINT) AS n, sum(c) / CAST(sum(s) AS DOUBLE) AS acc,
    avg(CASE WHEN s > 0 THEN c / CAST(s AS DOUBLE) END) AS bal,
    avg(CASE WHEN c = 0 THEN 0.0 ELSE 2.0 * c / CAST(s + p AS DOUBLE) END) AS f1,
    avg(CASE WHEN p = 0 THEN 0.0 ELSE c / CAST(p AS DOUBLE) END) AS pr,
    avg(CASE WHEN s = 0 THEN 0.0 ELSE c / CAST(s AS DOUBLE) END) AS rc FROM sl GROUP BY 1),
se AS (SELECT source_key, sum(CASE WHEN a.n_regionkey <> b.n_regionkey THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS x
  FROM sc JOIN nation a ON gt_attr = 'n' || a.n_nationkey JOIN nation b ON est_attr = 'n' || b.n_nationkey
  WHERE gt <> est GROUP BY 1),
si AS (SELECT source_key, count(DISTINCT image_key) AS images FROM preds GROUP BY 1)"""


@query(
    "per_source_scores",
    f"""WITH {PER_SOURCE} SELECT source_key, split_part(source_key, ':', 1) AS site, split_part(source_key, ':', 2) AS source_id,
        images AS num_val_images, n AS num_val_annotations, round_even(acc, 4) AS accuracy,
        round_even(bal, 4) AS balanced_accuracy, round_even(f1, 4) AS f1_macro, round_even(pr, 4) AS precision_macro,
        round_even(rc, 4) AS recall_macro, round_even(coalesce(x, 0), 4) AS cross_branch_error_rate
        FROM sm JOIN si USING (source_key) LEFT JOIN se USING (source_key)""",
)
def _(spark, sf):
    return per_source.per_source(
        per_source.source_scores(predictions(spark, sf), nation_classes(spark, sf))
    )


@query(
    "sources_attached",
    f"""WITH {PREDS}, img AS (SELECT CAST(o_orderkey AS VARCHAR) AS image_key, o_orderpriority AS project_id FROM orders
          WHERE o_orderstatus <> 'P')
        SELECT CASE WHEN project_id IS NOT NULL THEN 'site:' || project_id END AS source_key, count(*) AS n
        FROM preds LEFT JOIN img USING (image_key) GROUP BY 1""",
)
def _(spark, sf):
    images = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(
        text("o_orderkey").alias("image_key"), F.lit("site").alias("site"), F.col("o_orderpriority").alias("project_id")
    )
    found = per_source.attach_sources(predictions(spark, sf).drop("source_key"), images)
    return found.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "per_source_range",
    f"""WITH {PER_SOURCE} SELECT count(*) AS n_sources, {q('min(acc)')} AS min_accuracy, {q('max(acc)')} AS max_accuracy FROM sm""",
)
def _(spark, sf):
    return tidy(
        per_source.source_range(
            per_source.source_scores(predictions(spark, sf), nation_classes(spark, sf))
        )
    )


# --- probabilities ------------------------------------------------------------------------------


@query("log_loss", f"WITH {RANKS} SELECT {q('avg(-ln(least(greatest(p_true, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))')} AS log_loss FROM truth")
def _(spark, sf):
    return tidy(probability.log_loss(probs(spark, sf)))


@query(
    "log_loss_by_category",
    f"""WITH {RANKS} SELECT category, {q('avg(-ln(least(greatest(p_true, 1e-15), 1.0)))')} AS log_loss, count(*) AS n_samples
        FROM truth JOIN cats USING (gt) GROUP BY category HAVING count(*) >= 30""",
)
def _(spark, sf):
    return tidy(probability.category_log_loss(probs(spark, sf), prob_classes(spark, sf)))


@query(
    "label_encoding",
    """WITH c AS (SELECT DISTINCT p_brand AS class_id FROM part),
       e AS (SELECT class_id, CAST(row_number() OVER (ORDER BY class_id || '::') - 1 AS INTEGER) AS gt_idx FROM c)
       SELECT p_partkey, p_brand AS gt, gt_idx FROM part JOIN e ON p_brand = class_id""",
)
def _(spark, sf):
    samples = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("gt"))
    keyed = samples.select(F.concat("gt", F.lit("::")).alias("class_id"))
    classes = pin(taxonomy.class_list(keyed).withColumn("class_id", F.col("attribute_id")))
    probability.require_known_labels(samples, classes)
    return probability.encode_labels(samples, classes).select("p_partkey", "gt", "gt_idx")


@query(
    "labels_outside_class_list",
    f"""WITH {PREDS} SELECT DISTINCT gt FROM preds
        WHERE gt_attr NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey <> 2)""",
)
def _(spark, sf):
    known = nation_classes(spark, sf).where(F.col("root") != "r2")
    return probability.unknown_labels(predictions(spark, sf), known)


@query(
    "true_class_ranks",
    f"""WITH {RANKS} SELECT vec_id, gt AS gt_idx, CAST("rank" AS INTEGER) AS "rank" FROM ranks""",
)
def _(spark, sf):
    return ranking.with_rank(probs(spark, sf)).select("vec_id", "gt_idx", "rank")


_TOPK = ", ".join(q(f'avg(CASE WHEN "rank" <= {k} THEN 1.0 ELSE 0.0 END)') + f" AS {{0}}{k}{{1}}" for k in (1, 3, 5, 10))


@query(
    "topk_accuracy",
    f"WITH {RANKS} SELECT {_TOPK.format('top_', '_accuracy')}, {q('avg(1.0 / CAST(rank AS DOUBLE))')} AS mrr FROM ranks",
)
def _(spark, sf):
    return tidy(ranking.topk_scalars(ranking.with_rank(probs(spark, sf))))


@query(
    "topk_by_category",
    f"""WITH {RANKS} SELECT category, {_TOPK.format('top_', '')}, {q('avg(1.0 / CAST(rank AS DOUBLE))')} AS mrr,
        count(*) AS n_samples FROM ranks JOIN cats USING (gt) GROUP BY category HAVING count(*) >= 30""",
)
def _(spark, sf):
    return tidy(ranking.category_topk(ranking.with_rank(probs(spark, sf)), prob_classes(spark, sf)))


HIER = f"""{RANKS}, pos AS (SELECT vec_id, gt, k, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS pos FROM probs),
sim AS (SELECT vec_id, pos, CASE WHEN p.gt = p.k THEN 1.0 WHEN a.root = b.root THEN 0.5 ELSE 0.0 END AS s
  FROM pos p JOIN cats a ON p.gt = a.gt JOIN cats b ON p.k = b.gt),
best AS (SELECT vec_id, kk AS k, max(s) AS s FROM sim, (VALUES (1), (3), (5), (10)) v(kk) WHERE pos <= kk GROUP BY 1, 2)"""


@query(
    "hierarchical_topk",
    f"""WITH {HIER} SELECT k, {q('avg(s)')} AS mean_max_similarity,
        {q('avg(CASE WHEN s >= 1.0 THEN 1.0 ELSE 0.0 END)')} AS hit_exact,
        {q('avg(CASE WHEN s >= 0.75 THEN 1.0 ELSE 0.0 END)')} AS "hit_sibling_0.75",
        {q('avg(CASE WHEN s >= 0.5 THEN 1.0 ELSE 0.0 END)')} AS "hit_family_0.5" FROM best GROUP BY k""",
)
def _(spark, sf):
    df = ranking.hierarchical_topk(ranking.best_similarity(probs(spark, sf), prob_classes(spark, sf)))
    return df.select(
        "k", *[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) for c in df.columns if c != "k"]
    )


@query(
    "class_similarity",
    f"""WITH {RANKS}, c AS (SELECT DISTINCT x.gt, root FROM probs x JOIN cats USING (gt))
        SELECT a.gt AS gt_idx, b.gt AS other_idx, CAST(CASE WHEN a.gt = b.gt THEN 1.0 WHEN a.root = b.root THEN 0.5
          ELSE 0.0 END AS DOUBLE) AS similarity FROM c a CROSS JOIN c b""",
)
def _(spark, sf):
    rows = ranking.similarity_rows(prob_classes(spark, sf))
    return rows.select("gt_idx", F.posexplode("sims").alias("other_idx", "similarity"))


@query(
    "weighted_cross_entropy",
    f"""WITH {RANKS}, w AS (SELECT gt, 1.0 / count(*) AS weight FROM truth GROUP BY gt)
        SELECT {q('sum(weight * -ln(p_true)) / sum(weight)')} AS weighted_cross_entropy FROM truth JOIN w USING (gt)""",
)
def _(spark, sf):
    classes = prob_classes(spark, sf)
    rows = probs(spark, sf)
    weights = (
        probability.with_class(rows, classes)
        .groupBy(F.col("gt").alias("class_id"))
        .agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    )
    weights = pin(weights)
    probability.check_weights(classes, weights)
    return tidy(probability.weighted_cross_entropy(rows, classes, weights))


# --- all metric groups ----------------------------------------------------------------------------


def _all_metrics(spark, sf):
    # All groups read the predictions, so the joins that make them run once.
    walked = nation_walk(spark, sf)
    ctx = plan.Evaluation(
        stage(predictions(spark, sf, scored=True), "predictions"),
        nation_classes(spark, sf, walked),
        walked,
        PREDICTION_KEY,
    )
    return plan.evaluate(ctx, tables=False).scalars


SCALARS = f"""{COVER.replace(PREDS, CELLS)}, {PER_SOURCE.split(PREDS + ', ')[1]}, {OVERALL},
{ERRORS.split(CELLS + ', ')[1]}, {FORMED.split(CELLS + ', ')[1]}, {BINS.split(PREDS + ', ')[1]},
scalars AS (
  SELECT 'precision_macro' AS name, round_even(p, 3) AS value FROM macro
  UNION ALL SELECT 'recall_macro', round_even(r, 3) FROM macro
  UNION ALL SELECT 'f1_macro', round_even(2 * p * r / (p + r), 3) FROM macro
  UNION ALL SELECT 'balanced_accuracy', round_even(b, 3) FROM macro
  UNION ALL SELECT 'mcc', round_even((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 3) FROM macro
  UNION ALL SELECT 'accuracy', c / s FROM macro
  UNION ALL SELECT 'cross_branch_error_rate', sum(n) FILTER (WHERE lca IS NULL) / CAST(sum(n) AS DOUBLE) FROM wrong
  UNION ALL SELECT 'within_branch_error_rate', sum(n) FILTER (WHERE lca IS NOT NULL) / CAST(sum(n) AS DOUBLE) FROM wrong
  UNION ALL SELECT 'gf_accuracy_gf_relevant', sum(n) FILTER (WHERE gt_form = est_form) / CAST(sum(n) AS DOUBLE) FROM formed
  UNION ALL SELECT 'within_ba_gf_accuracy', sum(n) FILTER (WHERE same AND gt_form = est_form)
    / CAST(sum(n) FILTER (WHERE same) AS DOUBLE) FROM formed
  UNION ALL SELECT 'ece', sum(abs(hs - ss)) / sum(cnt) FROM bins
  UNION ALL SELECT 'cover_mean_abs_bias_pct', avg(abs(bias_pct)) FROM cover WHERE mean_true_cover_pct > 0.5
  UNION ALL SELECT 'cover_mean_rmse_pct', avg(rmse_pct) FROM cover WHERE mean_true_cover_pct > 0.5
  UNION ALL SELECT 'cover_mean_mae_pct', avg(mae_pct) FROM cover WHERE mean_true_cover_pct > 0.5
  UNION ALL SELECT 'cover_median_r_squared', median(r_squared) FROM cover
    WHERE mean_true_cover_pct > 0.5 AND NOT isnan(r_squared)
  UNION ALL SELECT 'per_source/n_sources', count(*) FROM sm
  UNION ALL SELECT 'per_source/min_accuracy', min(acc) FROM sm
  UNION ALL SELECT 'per_source/max_accuracy', max(acc) FROM sm)"""


@query("metric_scalars", f"WITH {SCALARS} SELECT name, {q('value')} AS value FROM scalars")
def _(spark, sf):
    return tidy(_all_metrics(spark, sf))


# --- run logs ---------------------------------------------------------------------------------

# A run is a user, an epoch is the position of the event in time, the loss is the event's value.
LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, value AS val_loss FROM events),
marked AS (SELECT *, min(val_loss) OVER w AS best_loss FROM log
  WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
firsts AS (SELECT run_id, val_loss, min(epoch) AS first_at FROM log GROUP BY 1, 2),
best AS (SELECT m.*, f.first_at AS best_epoch, epoch - f.first_at AS since_best FROM marked m
  JOIN firsts f ON m.run_id = f.run_id AND f.val_loss = m.best_loss)"""


def _log(spark, sf):
    events = table(spark, sf, "events").select(
        text("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("val_loss")
    )
    return runs.numbered_epochs(events, "run_id", ["ts", "event_id"]).select("run_id", "epoch", "val_loss")


@query(
    "run_best_so_far",
    f"WITH {LOG} SELECT run_id, epoch, val_loss, best_loss, best_epoch, since_best FROM best",
)
def _(spark, sf):
    return runs.best_so_far(_log(spark, sf))


@query(
    "run_early_stopping",
    f"""WITH {LOG}, stops AS (SELECT run_id, min(epoch) FILTER (WHERE since_best >= 5) AS stop, max(epoch) AS last
          FROM best GROUP BY 1)
        SELECT b.run_id, epoch + 1 AS final_epoch, stop IS NOT NULL AS early_stopped, best_epoch + 1 AS best_val_epoch,
          best_loss AS best_val_loss FROM stops s JOIN best b ON b.run_id = s.run_id AND b.epoch = coalesce(stop, last)""",
)
def _(spark, sf):
    return runs.early_stopping(_log(spark, sf), 5)


@query(
    "epoch_metrics",
    f"""WITH {PROBS}, est AS (SELECT vec_id, arg_min(k, (-p, k)) AS est FROM probs GROUP BY 1)
        SELECT 'run' AS run_id, CAST(vec_id // 100 AS BIGINT) AS epoch,
          CASE WHEN vec_id % 2 = 0 THEN 'ref' ELSE 'val' END AS split,
          {q('avg(CASE WHEN gt = est THEN 1.0 ELSE 0.0 END)')} AS accuracy,
          {q('avg(-ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))')} AS log_loss, count(*) AS n
        FROM probs JOIN est USING (vec_id) WHERE gt = k GROUP BY ALL""",
)
def _(spark, sf):
    rows = probs(spark, sf).select(
        F.lit("run").alias("run_id"),
        F.floor(F.col("vec_id") / 100).alias("epoch"),
        F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("val").alias("split"),
        F.col("gt_idx").alias("gt"),
        "proba",
    )
    return tidy(runs.epoch_metrics(rows))


@query("outcome_counts", "SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return runs.outcome_counts(table(spark, sf, "events").withColumnRenamed("event_type", "outcome"))


@query(
    "table_fingerprint",
    """WITH h AS (SELECT sha256('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":'
          || s_nationkey || ',"s_acctbal":' || CAST(s_acctbal AS VARCHAR) || '}') AS x FROM supplier),
       p AS (SELECT count(*) AS n, CAST(sum(CAST('0x' || x[1:12] AS BIGINT)) AS VARCHAR) AS p0,
               CAST(sum(CAST('0x' || x[13:24] AS BIGINT)) AS VARCHAR) AS p1 FROM h)
       SELECT n AS rows, sha256(n || '|' || p0 || '|' || p1)[1:10] AS fingerprint FROM p""",
)
def _(spark, sf):
    return runs.fingerprint(table(spark, sf, "supplier"))
