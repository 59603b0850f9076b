"""Importance resampling of documents towards a target distribution of word n-grams.

Every n-gram falls into a bucket by the CRC-32 of its bytes. A bucket's gain is the rounded logarithm of how much more often the target has it than the documents
do; a document's weight is the mean gain of its n-grams, and Gumbel noise from a hash of its id turns the highest scores into a draw without replacement.

Within a batch of texts the n-grams are interned in an open-addressed table of NumPy arrays (``intern``): a slot is claimed by the low bits of the gram's XXH64, and
shared only by grams whose bytes are equal. A slot holds the bucket and the count, so a bucket is computed once for each distinct gram; the slot number
of each occurrence then gathers the gains.

The documents are scanned twice and not moved. Bucket counts are added up by Spark; the gains, one number for each of ``buckets``, are broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrat.llm.text import WORD_TABLE, append_columns, blobs, text_slices
from quadrat.operators.ranking import ranked
from quadrat.operators.staging import stage


@dataclass
class Interned:
    """Slot of each occurrence, and per slot its bucket and count (0 where it is free)."""

    slots: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``sizes`` bytes from ``a`` on are those from ``b`` on; eight bytes of all are compared at once."""
    same = np.ones(len(a), dtype=bool)
    rows, step, done = np.flatnonzero(a != b), np.arange(8), 0
    while len(rows):
        reach = done + step
        differ = data[a[rows, None] + reach] != data[b[rows, None] + reach]
        same[rows[(differ & (reach < sizes[rows, None])).any(axis=1)]] = False
        done += 8
        rows = rows[same[rows] & (sizes[rows] > done)]
    return same


def intern(grams: list[bytes], buckets: int, hashes: np.ndarray | None = None) -> Interned:
    """Open addressing with steps of one; of the occurrences that meet a free slot together one claims it, and the others are compared with it."""
    n = len(grams)
    sizes = np.fromiter(map(len, grams), np.int64, n)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(grams) + bytes(8), np.uint8)
    keys = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, n) if hashes is None else hashes
    capacity = 1 << max(4, (2 * n).bit_length())
    slots = (keys & np.uint64(capacity - 1)).astype(np.int64)
    holder = np.full(capacity, -1, dtype=np.int64)
    unplaced = np.arange(n)
    while len(unplaced):
        at = slots[unplaced]
        free = holder[at] < 0
        holder[at[free]] = unplaced[free]
        owner = holder[at]
        same = (keys[owner] == keys[unplaced]) & (sizes[owner] == sizes[unplaced])
        likely = np.flatnonzero(same)
        same[likely] = _equal_bytes(data, starts[owner[likely]], starts[unplaced[likely]], sizes[unplaced[likely]])
        unplaced = unplaced[~same]
        slots[unplaced] = (slots[unplaced] + 1) & (capacity - 1)
    bucket = np.zeros(capacity, dtype=np.int64)
    used = np.flatnonzero(holder >= 0)
    bucket[used] = [zlib.crc32(grams[k]) % buckets for k in holder[used].tolist()]
    return Interned(slots, bucket, np.bincount(slots, minlength=capacity))


def grams_of(text: bytes, longest: int) -> tuple[list[bytes], int]:
    """All runs of 1 to ``longest`` consecutive words, joined by a space, and the number of words."""
    words = text.translate(WORD_TABLE).split()
    grams = list(words)
    for n in range(2, longest + 1):
        grams += [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return grams, len(words)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Number of n-grams of all texts in each bucket. A NULL text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in text_slices(batches, text):
            table = intern([g for t in blobs(batch, text) for g in grams_of(t, longest)[0]], buckets)
            used = np.flatnonzero(table.count)
            np.add.at(total, table.bucket[used], table.count[used])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    parts = texts.select(text).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket at most
        out[row.bucket] = row.n
    return out


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares), target over documents, for each bucket."""
    n = float(len(documents))
    all_documents, all_target = float(documents.sum()), float(target.sum())
    ratios = ((target + 1.0) * (all_documents + n)) / ((documents + 1.0) * (all_target + n))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratios.tolist()], dtype=np.int64)


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 of ``seed:key``; a NULL key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def score_documents(
    documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024
) -> DataFrame:
    """``documents`` with ``__features``, ``__words``, ``__weight`` and ``__score``, all long.

    ``__features`` is the number of n-grams, repeats counted; ``__weight`` their mean gain, rounded down, and 0 without any; ``__score`` is the weight and the noise. A
    NULL text is empty. Repeated rows count each in the statistics and get the same score; an empty target or table is taken as it is. Columns of the documents with
    such a name are replaced; all other columns stay.
    """
    added = ["__features", "__words", "__weight", "__score"]
    documents = documents.drop(*added)
    gains = bucket_gains(bucket_counts(documents, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    shared = documents.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            parts = [grams_of(t, longest) for t in blobs(batch, text)]
            features = np.array([len(g) for g, _ in parts], dtype=np.int64)
            table = intern([g for grams, _ in parts for g in grams], buckets)
            total = np.zeros(len(parts), dtype=np.int64)
            np.add.at(total, np.repeat(np.arange(len(parts)), features), shared.value[table.bucket][table.slots])
            weight = total // np.maximum(features, 1)
            words = np.array([w for _, w in parts], dtype=np.int64)
            yield append_columns(batch, __features=pa.array(features), __words=pa.array(words), __weight=pa.array(weight))

    schema = StructType([*documents.schema.fields]).add("__features", "long").add("__words", "long").add("__weight", "long")
    weighed = documents.mapInArrow(weigh, schema)
    return weighed.withColumn("__score", F.col("__weight") + gumbel(F.col(key), seed))


def rank_documents(scored: DataFrame, key: str = "doc_id", least_words: int = 20, percent: int = 10) -> DataFrame:
    """``scored`` with ``__rank``: 1, 2, 3 ... along falling scores, equal ones by smaller key, for those drawn; NULL for all others.

    Of the N rows with at least ``least_words`` words, floor(``percent`` N / 100) are drawn. Rows equal in score and key follow one another by weight and features.
    """
    scored = stage(scored.drop("__rank"), "scored")
    fit = F.col("__words") >= least_words
    quota = scored.where(fit).count() * percent // 100
    order = [F.col("__score").desc(), F.col(key).asc_nulls_first(), F.col("__weight"), F.col("__features")]
    numbered = ranked(scored.where(fit), [], order, "__rank")
    numbered = numbered.withColumn("__rank", F.when(F.col("__rank") <= quota, F.col("__rank")))
    return numbered.unionByName(scored.where(~fit).withColumn("__rank", F.lit(None).cast("long")))


def draw(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 20, percent: int = 10, **options) -> DataFrame:
    """The drawn documents, with their own columns only."""
    drawn = rank_documents(score_documents(documents, target, key, text, **options), key, least_words, percent)
    return drawn.where(F.col("__rank").isNotNull()).select(*documents.columns)
