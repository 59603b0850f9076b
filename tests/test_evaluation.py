import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrat.evaluation import calibration, classification, confusion, cover, forms, hierarchy, per_source, probability, ranking
from quadrat.operators import taxonomy
from quadrat.operators.ranking import ranked
from quadrat.plans import evaluate as plan

from .conftest import rows

NODES = [("A", "Acro", None), ("A1", "A one", "A"), ("A2", "A two", "A"), ("B", "Bare", None), ("B1", "B one", "B"), ("B2", "B two", "B")]
CLASSES = ["A1::", "A1::g1", "A2::g2", "B1::", "B2::g1", "B2::g3"]
PRED_SCHEMA = "i int, image_key string, source_key string, gt string, est string, score double"


@pytest.fixture(scope="module")
def walked(spark):
    return taxonomy.paths(spark.createDataFrame(NODES, "id string, name string, parent string"))


@pytest.fixture(scope="module")
def classes(spark, walked):
    keys = spark.createDataFrame([(c,) for c in CLASSES], "class_id string")
    names = spark.createDataFrame([("g1", "one"), ("g2", "two"), ("g3", "three")], "id string, name string")
    return taxonomy.class_table(taxonomy.class_list(keys), walked, names)


def make(n, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        gt = rng.choice(CLASSES[:5])
        est = gt if rng.random() < 0.6 else rng.choice(CLASSES)
        # Some scores are equal, so that the tie rule matters.
        out.append((i, f"m{i % 9}", f"site:{'hot' if i % 3 else i % 5}", gt, est, round(rng.random(), 2)))
    return out


@pytest.fixture(scope="module")
def data():
    return make(211)


@pytest.fixture(scope="module")
def preds(spark, data):
    return spark.createDataFrame(data, PRED_SCHEMA).cache()


def scores_of(pairs, labels):
    out = {}
    for c in labels:
        tp = sum(g == e == c for g, e in pairs)
        s, p = sum(g == c for g, _ in pairs), sum(e == c for _, e in pairs)
        out[c] = (tp / p if p else 0.0, tp / s if s else 0.0, 2 * tp / (s + p) if tp else 0.0, s)
    return out


def test_confusion_matrix(data, preds, classes):
    full = confusion.full_confusion(confusion.confusion(preds), classes)
    got = {(r["gt"], r["est"]): (r["n"], r["pct"]) for r in full.collect()}
    assert len(got) == 36
    for g in CLASSES:
        total = sum(d[3] == g for d in data)
        for e in CLASSES:
            n = sum(d[3] == g and d[4] == e for d in data)
            assert got[g, e] == (n, 100 * n // total if total else 0)
    wide = confusion.wide_confusion(full, classes).collect()
    assert [r["-"] for r in wide] == ["A one", "A one::one", "A two::two", "B one", "B two::one", "B two::three"]
    assert wide[0]["A one"] == got["A1::", "A1::"][0]


def test_profile_distances(data, preds, classes):
    matrix = np.zeros((6, 6))
    for d in data:
        matrix[CLASSES.index(d[3]), CLASSES.index(d[4])] += 1
    sums = matrix.sum(axis=1, keepdims=True)
    sums[sums == 0] = 1
    unit = matrix / sums
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    norms[norms == 0] = 1
    want = 1 - (unit / norms) @ (unit / norms).T
    got = confusion.profile_distances(confusion.confusion(preds), classes).collect()
    assert len(got) == 15
    for r in got:
        assert r["distance"] == pytest.approx(want[CLASSES.index(r["gt_a"]), CLASSES.index(r["gt_b"])])


def test_classification(data, preds, classes):
    cells = confusion.confusion(preds)
    pairs = [(d[3], d[4]) for d in data]
    want = scores_of(pairs, CLASSES)
    for r in classification.per_label(cells, classes).collect():
        assert (r["precision"], r["recall"], r["f1_score"], r["n_samples"]) == pytest.approx(want[r["class_id"]])
    one = classification.overall(cells).first()
    used = {x for p in pairs for x in p}
    macro_p, macro_r = (np.mean([want[c][i] for c in used]) for i in (0, 1))
    assert one["f1_macro"] == pytest.approx(2 * macro_p * macro_r / (macro_p + macro_r))
    assert one["balanced_accuracy"] == pytest.approx(np.mean([want[c][1] for c in used if want[c][3]]))
    # The correlation coefficient by its covariance definition.
    x, y = (np.array([[v == c for c in CLASSES] for v in col], float) for col in zip(*pairs))
    cov = lambda u, v: ((u - u.mean(0)) * (v - v.mean(0))).sum()
    assert one["mcc"] == pytest.approx(cov(x, y) / math.sqrt(cov(x, x) * cov(y, y)))


def test_all_one_class(spark, classes):
    same = spark.createDataFrame([(0, "m", "s:1", "A1::", "A1::", 0.5)] * 3, PRED_SCHEMA)
    cells = confusion.confusion(same)
    one = classification.overall(cells).first()
    assert (one["mcc"], one["accuracy"], one["f1_macro"]) == (0.0, 1.0, 1.0)
    rates = hierarchy.branch_error_rates(cells, classes).first()
    assert tuple(rates) == (0.0, 0.0)
    formed = forms.form_cells(cells, classes)
    assert tuple(forms.form_accuracy(formed).first()) == (0.0, 0.0)
    assert forms.form_scores(formed).count() == 0


def test_error_attribution(data, preds, classes, walked):
    parent = {n: p for n, _, p in NODES}
    names = {n: name for n, name, _ in NODES}
    want = {}
    for d in data:
        if d[3] == d[4]:
            continue
        a, b = d[3].split("::")[0], d[4].split("::")[0]
        lca = a if a == b else parent[a] if parent[a] == parent[b] else None
        want[lca] = want.get(lca, 0) + 1
    got = hierarchy.error_attribution(confusion.confusion(preds), classes, walked)
    table = {r["lca_node"]: r for r in got.collect()}
    total = sum(want.values())
    assert len(table) == len(want)
    for lca, n in want.items():
        r = table[lca or "(cross-branch)"]
        assert r["error_count"] == n and r["pct_of_errors"] == pytest.approx(100 * n / total)
        assert r["classes_in_subtree"] == (0 if lca is None else 2 if parent[lca] is None else 1)
        assert r["lca_name"] == (names[lca] if lca else "(cross-branch)")
    counts = [r["error_count"] for r in got.collect()]
    assert counts == sorted(counts, reverse=True)
    rates = hierarchy.branch_error_rates(confusion.confusion(preds), classes).first()
    assert rates["cross_branch_error_rate"] == pytest.approx(want[None] / total)


def test_root_confusion_positions(spark, classes):
    pairs = [("A1::", "B1::")] * 3 + [("A1::", "A1::")] * 5
    cells = confusion.confusion(spark.createDataFrame([(i, "m", "s", g, e, 0.1) for i, (g, e) in enumerate(pairs)], PRED_SCHEMA))
    rolled = hierarchy.root_confusion(cells, classes)
    assert rows(hierarchy.root_confusions(rolled)) == [("Acro", "Bare", 37, 3)]
    assert rows(hierarchy.root_order(rolled), "root", "position") == [("A", 1), ("B", 2)]
    assert rows(hierarchy.only_predicted(rolled)) == [("B",)]


def test_forms(data, preds, classes):
    formed = forms.form_cells(confusion.confusion(preds), classes)
    rel = [(d[3].split("::"), d[4].split("::")) for d in data if not d[3].endswith("::")]
    one = forms.form_accuracy(formed).first()
    assert one[0] == pytest.approx(np.mean([g[1] == e[1] for g, e in rel]))
    assert one[1] == pytest.approx(np.mean([g[1] == e[1] for g, e in rel if g[0] == e[0]]))
    name = {"": "(no GF)", "g1": "one", "g2": "two", "g3": "three"}
    want = scores_of([(name[g[1]], name[e[1]]) for g, e in rel], ["one", "two"])
    for r in forms.form_scores(formed).collect():
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(want[r["growth_form"]][:3], abs=6e-4)
    cells = {(r["gt"], r["est"]) for r in forms.form_confusion(formed).collect()}
    assert all(e in ("one", "two", "(no GF)") for _, e in cells)


def brute_bins(items, n_bins):
    """Bins over exact integer edges of the sorted rows."""
    items = sorted(items)
    n = len(items)
    edges = [i * n // n_bins for i in range(n_bins + 1)]
    return [items[a:b] for a, b in zip(edges, edges[1:]) if a < b]


def brute_ece(bins, n):
    return sum(abs(np.mean([h for *_, h in b]) - np.mean([s for s, *_ in b])) * len(b) for b in bins) / n


def test_calibration(spark, data, preds, classes):
    for n in (25, 7, 211):
        some = preds.where(F.col("i") < n)
        want = brute_bins([(d[5], d[0], d[3] == d[4]) for d in data[:n]], 20)
        bins = calibration.equal_mass_bins(calibration.scored_rows(some, ["i"]), F.lit(20))
        table = calibration.bin_table(bins).collect()
        assert [r["count"] for r in table] == [len(b) for b in want]
        assert [r["bin"] for r in table] == list(range(1, len(want) + 1))
        assert [r["avg_accuracy"] for r in table] == pytest.approx([np.mean([h for *_, h in b]) for b in want])
        assert calibration.ece(bins).first()[0] == pytest.approx(brute_ece(want, n))
    got = calibration.category_ece(calibration.scored_rows(preds, ["i"], ["gt"]), classes).collect()
    for r in got:
        part = [(d[5], d[0], d[3] == d[4]) for d in data if d[3].startswith(r["category"][0])]
        n_bins = min(20, max(2, len(part) // 10))
        assert r["n_samples"] == len(part)
        assert r["ece"] == pytest.approx(brute_ece(brute_bins(part, n_bins), len(part)))
    assert [r["ece"] for r in got] == sorted([r["ece"] for r in got], reverse=True)


def test_cover(data, preds):
    images = sorted({d[1] for d in data})
    used = sorted({d[3] for d in data} | {d[4] for d in data})
    share = lambda im, c, at: np.mean([d[at] == c for d in data if d[1] == im])
    t = np.array([[share(im, c, 3) for c in used] for im in images])
    p = np.array([[share(im, c, 4) for c in used] for im in images])
    err = p - t
    got = {r["class_id"]: r for r in cover.cover_by_class(preds).collect()}
    for k, c in enumerate(used):
        r = got[c]
        assert r["mean_true_cover_pct"] == pytest.approx(100 * t[:, k].mean())
        assert r["bias_pct"] == pytest.approx(100 * err[:, k].mean())
        assert r["rmse_pct"] == pytest.approx(100 * math.sqrt((err[:, k] ** 2).mean()))
        assert r["mae_pct"] == pytest.approx(100 * abs(err[:, k]).mean())
        if t[:, k].std() > 0:
            want = 1 - (err[:, k] ** 2).sum() / ((t[:, k] - t[:, k].mean()) ** 2).sum()
            assert r["r_squared"] == pytest.approx(want)
        else:
            assert math.isnan(r["r_squared"])
    kept = [k for k, c in enumerate(used) if 100 * t[:, k].mean() > 0.5]
    one = cover.cover_scalars(cover.cover_by_class(preds)).first()
    assert one["cover_mean_abs_bias_pct"] == pytest.approx(np.mean([abs(100 * err[:, k].mean()) for k in kept]))


def test_cover_constant_and_empty(spark):
    same = spark.createDataFrame(
        [(0, "m1", "s", "A", "A", 1.0), (1, "m2", "s", "A", "B", 1.0)], PRED_SCHEMA
    )
    table = cover.cover_by_class(same)
    assert all(math.isnan(r["r_squared"]) for r in table.collect())
    one = cover.cover_scalars(table).first()
    assert math.isnan(one["cover_median_r_squared"]) and one["cover_mean_abs_bias_pct"] == pytest.approx(50.0)
    empty = cover.cover_scalars(table.limit(0)).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)


def test_per_source(data, preds, classes):
    scores = per_source.source_scores(preds, classes)
    for r in scores.collect():
        part = [d for d in data if d[2] == r["source_key"]]
        pairs = [(d[3], d[4]) for d in part]
        used = {x for p in pairs for x in p}
        want = scores_of(pairs, used)
        assert r["num_val_annotations"] == len(part) and r["num_val_images"] == len({d[1] for d in part})
        assert r["accuracy"] == pytest.approx(np.mean([g == e for g, e in pairs]))
        assert r["f1_macro"] == pytest.approx(np.mean([want[c][2] for c in used]))
        assert r["balanced_accuracy"] == pytest.approx(np.mean([want[c][1] for c in used if want[c][3]]))
        wrong = [(g, e) for g, e in pairs if g != e]
        assert r["cross_branch_error_rate"] == pytest.approx(np.mean([g[0] != e[0] for g, e in wrong]) if wrong else 0)
    table = per_source.per_source(scores).collect()
    assert table[0]["source_id"] == "hot" and table[0]["site"] == "site"
    assert per_source.source_range(scores).first()["n_sources"] == len(table)


@pytest.fixture(scope="module")
def probs(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(6), size=90)
    p[0] = [0.5, 0.5, 0, 0, 0, 0]
    gt = rng.integers(0, 6, 90)
    gt[0] = 1
    frame = [(int(i), int(g), [float(v) for v in row]) for i, (g, row) in enumerate(zip(gt, p))]
    return p, gt, spark.createDataFrame(frame, "i int, gt_idx int, proba array<double>").cache()


def test_log_loss_and_ranks(probs, classes):
    p, gt, df = probs
    p_true = p[np.arange(90), gt]
    assert probability.log_loss(df).first()[0] == pytest.approx(-np.log(np.clip(p_true, 2.3e-16, 1)).mean())
    for r in probability.category_log_loss(df, classes).collect():
        inside = np.array([CLASSES[g][0] == r["category"][0] for g in gt])
        assert r["log_loss"] == pytest.approx(-np.log(p_true[inside]).mean()) and r["n_samples"] == inside.sum()
    order = np.argsort(-p, axis=1, kind="stable")
    want = [int(np.where(order[i] == gt[i])[0][0]) + 1 for i in range(90)]
    ranks = ranking.with_rank(df)
    assert [r["rank"] for r in ranks.orderBy("i").collect()] == want
    one = ranking.topk_scalars(ranks).first()
    assert one["top_3_accuracy"] == pytest.approx(np.mean(np.array(want) <= 3))
    assert one["mrr"] == pytest.approx(np.mean(1 / np.array(want)))
    sim = lambda a, b: 1.0 if a == b else 0.5 if a[0] == b[0] else 0.0
    attrs = [c.split("::")[0] for c in CLASSES]
    hier = {r["k"]: r for r in ranking.hierarchical_topk(ranking.best_similarity(df, classes)).collect()}
    for k in (1, 3, 5, 10):
        best = [max(sim(attrs[gt[i]], attrs[j]) for j in order[i, :k]) for i in range(90)]
        assert hier[k]["mean_max_similarity"] == pytest.approx(np.mean(best))
        assert hier[k]["hit_family_0.5"] == pytest.approx(np.mean(np.array(best) >= 0.5))


def test_weighted_loss_and_label_checks(spark, probs, classes):
    p, gt, df = probs
    safe = df.where("i > 0")
    w = {c: i + 1.0 for i, c in enumerate(CLASSES)}
    weights = spark.createDataFrame(list(w.items()), "class_id string, weight double")
    probability.check_weights(classes, weights)
    ws = np.array([w[CLASSES[g]] for g in gt])[1:]
    want = (ws * -np.log(p[np.arange(90), gt][1:])).sum() / ws.sum()
    assert probability.weighted_cross_entropy(safe, classes, weights).first()[0] == pytest.approx(want)
    with pytest.raises(ValueError, match="A1::g1"):
        probability.check_weights(classes, weights.where("class_id <> 'A1::g1'"))
    samples = spark.createDataFrame([("B1::",), ("A1::",)], "gt string")
    assert rows(probability.encode_labels(samples, classes)) == [("A1::", 0), ("B1::", 3)]
    with pytest.raises(ValueError, match="zzz"):
        probability.require_known_labels(spark.createDataFrame([("zzz",)], "gt string"), classes)


def test_metric_groups(spark, preds, classes, walked, probs):
    def context(**change):
        base = dict(predictions=preds, classes=classes, walked=walked, key=["i"], probs=probs[2])
        return plan.Evaluation(**{**base, **change})

    assert [g.name for g in plan.applicable(context())][-2:] == ["probability", "ranking"]
    slim = [g.name for g in plan.applicable(context(probs=None, has_sources=False))]
    assert slim == ["confusion_matrices", "precision_recall_f1", "balanced_accuracy_mcc", "taxonomic", "calibration"]

    def broken(_):
        raise RuntimeError("broken group")

    picked = (plan.MetricGroup("broken", broken), *[g for g in plan.GROUPS if g.name in ("balanced_accuracy_mcc", "ranking")])
    def late(_):
        """A table that fails only where it is computed."""
        bad = spark.range(3).select(F.assert_true(F.col("id") < 1).alias("x"))
        return plan.GroupResult(tables={"late": bad})

    picked += (plan.MetricGroup("late", late),)
    got = plan.evaluate(context(), picked)
    names = {r["name"] for r in got.scalars.collect()}
    assert {"mcc", "accuracy", "top_1_accuracy", "hierarchical_top_5_mean_similarity"} <= names
    assert set(got.tables) == {"ranking/per_category_topk", "ranking/hierarchical_topk"}
    assert set(got.failed) == {"broken", "late"} and got.failed["broken"] == "broken group"
    none = plan.evaluate(context(predictions=preds.limit(0)))
    assert (none.scalars, none.tables, set(none.failed)) == (None, {}, {"evaluation"})
    strange = spark.createDataFrame([(0, "m", "s", "A1::", "none::", 0.5)], PRED_SCHEMA)
    assert plan.evaluate(context(predictions=strange)).scalars is None


def test_all_tables_or_scalars_only(spark, preds, classes, walked, probs):
    def evaluated(tables):
        return plan.evaluate(plan.Evaluation(preds, classes, walked, ["i"], probs[2]), tables=tables)

    whole, slim = evaluated(True), evaluated(False)
    assert not whole.failed and not slim.failed and slim.tables == {}
    assert rows(whole.scalars) == rows(slim.scalars)
    assert set(whole.tables) == {
        "confusion_matrix/frequencies", "confusion_matrix/percents", "metrics_per_label", "taxonomic/error_attribution",
        "taxonomic/branch_errors", "taxonomic/top_level_confusions", "taxonomic/gf_precision_recall_f1",
        "taxonomic/gf_confusion", "calibration/per_bin_details", "calibration/per_category_ece",
        "cover/per_class_cover_metrics", "per_source/metrics", "probability/per_category_log_loss",
        "ranking/per_category_topk", "ranking/hierarchical_topk",
    }
    assert sum(r["n"] for r in confusion.confusion(preds).collect()) == preds.count()
    binned = whole.tables["calibration/per_bin_details"].collect()
    assert [r["bin"] for r in binned] == list(range(1, len(binned) + 1))
    assert sum(r["count"] for r in binned) == preds.count()


def test_nan_scalars_left_out(spark):
    one = spark.createDataFrame([(1.0, float("nan"), None)], "a double, b double, c double")
    assert rows(plan.long_scalars(one)) == [("a", 1.0)]


def test_bins_rank_only_where_one_ends(spark, monkeypatch):
    data = [(None if i == 3 else float("nan") if i == 4 else 0.5 if i < 40 else (i * 37 % 100) / 100, i % 2, i) for i in range(200)]
    scored = spark.createDataFrame(data, "score double, hit long, _key0 long")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", "_key0"))
    plain = scored.withColumn("bin", F.floor((place * 7 - 1) / 200))
    columns = ("bin", "count", "hit_sum", "conf_min", "conf_max")
    want = plain.groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"), F.sum("hit").alias("hit_sum"), F.min("score").alias("conf_min"), F.max("score").alias("conf_max")
    )
    seen = []

    def counting(df, *rest):
        seen.append(df.count())
        return ranked(df, *rest)

    monkeypatch.setattr(calibration, "ranked", counting)
    for steps in (1, 10, 1 << 16):
        monkeypatch.setattr(calibration, "STEPS", steps)
        got = calibration.equal_mass_bins(scored, F.lit(7))
        assert [repr(r) for r in rows(got, *columns)] == [repr(r) for r in rows(want, *columns)]
    assert seen[0] > seen[-1] and seen[-1] < 60


def test_counted_cover_meets_by_image_once(spark):
    counted = spark.createDataFrame(
        [("i1", "a", "a", 3), ("i1", "a", "b", 1), ("i2", "b", "b", 2)], "image_key string, gt string, est string, n_points long"
    )
    out = cover.image_cover(counted)
    assert rows(out, "image_key", "class_id", "true_share", "pred_share") == [
        ("i1", "a", 1.0, 0.75), ("i1", "b", 0.0, 0.25), ("i2", "b", 1.0, 1.0),
    ]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
