"""The registered classifier queries over whole tables: columns, fold, threshold, and what they get right on held-out rows."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quadrat.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"  # the smaller tables hold a handful of held-out positives


def area(label, score):
    """Share of (positive, negative) pairs in the right order, equal scores counting half."""
    high, low = score[label == 1], score[label == 0]
    return ((high[:, None] > low).mean() + (high[:, None] >= low).mean()) / 2


@pytest.mark.parametrize(
    "name, column, threshold, least",
    [("op3_toxicity", "toxic", 0.5, 0.97), ("op10_quality", "quality", 0.3, 0.9)],
)
def test_registered_classifier(spark, name, column, threshold, least):
    got = QUERIES[name][0](spark, SF)
    assert dict(got.dtypes) | {"doc_id": "", "held_out": "boolean", "score": "double", "predicted": "int"} == dict(got.dtypes) | {"doc_id": ""}
    got = got.collect()
    ids = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).column("doc_id").to_pylist()
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == (r["score"] >= threshold)
    table = pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", column])
    truth = dict(zip(*[c.to_pylist() for c in table.columns]))
    held = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    label, score, predicted = (np.array(v) for v in zip(*held))
    assert len(held) > 50 and 0 < label.sum() < len(label)
    assert area(label, score) >= least
    assert (predicted == label).mean() > max(label.mean(), 1 - label.mean())
