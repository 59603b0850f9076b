"""The corpus pipeline, stage by stage, against brute force on the smallest test tables and on odd rows."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quadrat.llm import toxicity
from tests.llm import brute
from tests.llm.test_documents import ODD, SF, check_shards, odd_rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it returned, as lists of rows."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(root / name))
        after = spark.read.parquet(str(root / name))
        seen.append((name, docs.columns, docs.collect(), after.columns, after.collect()))
        docs = after
    return {name: (columns, before, out_columns, after) for name, columns, before, out_columns, after in seen}


def test_stages_are_in_order(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "source_mix", "sharding"]
    for name, (columns, _, out_columns, _) in stages.items():
        assert out_columns[: len(columns)] == columns
        assert len(out_columns) == len(columns) or name == "sharding"


def test_toxicity(spark, stages):
    _, before, _, after = stages["toxicity"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weights = dict(zip(model.coordinates.tolist(), model.weights.tolist()))
    kept = []
    for r in before:
        (own,) = toxicity.feature_sets([(r.text or "").encode()])
        if model.bias + sum(weights.get(c, 0.0) for c in own.tolist()) < 0:
            kept.append(r.doc_id)
    assert sorted(kept) == sorted(r.doc_id for r in after)
    assert 0 < len(kept) < len(before)


def test_near_duplicates(stages):
    _, before, _, after = stages["near_duplicates"]
    classes = brute.near_classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({component for _, component in classes.values()})
    assert len(after) < len(before)


def test_decontamination(spark, stages):
    _, before, _, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r[0] for r in brute.contamination([(r.doc_id, r.text) for r in before], items) if not r[5]]
    assert sorted(clean) == sorted(r.doc_id for r in after)
    assert len(after) < len(before)


def test_source_mix(stages):
    _, before, _, after = stages["source_mix"]
    size = {r.doc_id: len(brute.TOKEN.findall(r.text or "")) for r in before}
    sources, taken, copies = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in after)
    for r in before:
        sources[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * copies[r.doc_id]
    assert set(copies) <= set(size) and max(copies.values()) == 2
    for source, target in brute.targets(dict(sources)).items():
        assert abs(taken[source] - target) <= 0.02 * target + 50


def test_sharding(stages):
    _, before, _, after = stages["sharding"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    assert all(r.shard_bytes == len((r.text or "").encode()) + 8 for r in after)
    check_shards([(r.shard_bytes, r.shard, r.slot) for r in after])


def test_run_applies_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    want = stages["sharding"][3]
    assert Counter((r.doc_id, r.shard) for r in got.collect()) == Counter((r.doc_id, r.shard) for r in want)


def test_odd_rows_go_through(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0
    empty = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
