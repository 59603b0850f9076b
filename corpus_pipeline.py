"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, source mix and shards, in this order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import decontaminate, mixing, sharding, simhash, toxicity
from quadrat.operators.staging import staging_root


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model is fitted on the labelled ones among ``docs``."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the source mix takes them."""
    return mixing.draw(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy with ``shard_bytes``, ``shard`` and ``slot``, beside the columns of the documents.

    Where the documents have a column of such a name, the new one gets underscores behind it.
    """
    out = sharding.shard_by_bytes(docs)
    taken = {c.lower() for c in docs.columns}
    added = []
    for name, made in (("shard_bytes", "__size"), ("shard", "__shard"), ("slot", "__slot")):
        while name in taken:
            name += "_"
        added.append(F.col(made).alias(name))
    return out.select(*[out[c] for c in docs.columns], *added)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("source_mix", mix_sources),
    ("sharding", shard),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{staging_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
