"""SimHash near-duplicates found with BK-trees.

The fingerprint of a text has 64 bits; bit i is 1 if it is set in over half of the XXH64 hashes of the text's
3-word shingles. Fingerprints link at Hamming distances up to ``RADIUS``.

Links are searched between distinct fingerprints. A fingerprint is cut into four blocks of 16 bits; of two
fingerprints that differ in at most two bits, at least two blocks agree, so each fingerprint goes to six
shards, one for each pair of blocks. Shards of more than ``SHARD_LIMIT`` fingerprints are cut again in the same
way by four blocks of the 32 bits that are left, after which only 16 bits are free and a shard has at most 65,536
members whatever the data. Each shard gets a BK-tree: a child is kept under the integer Hamming distance to
its parent, and a search follows only edges within the radius of the distance to the node. The trees grow with
the data, so they are not broadcast whole; a tree and the fingerprints that can meet it travel to one task.
A search that joins a new member to its links keeps one edge for each member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.components import connected
from quadrat.llm.text import append_columns, blobs, text_slices
from quadrat.operators.staging import stage

WORDS = 3
SEED = 42
RADIUS = 2
SHARD_LIMIT = 4096
_PAIRS = list(combinations(range(4), 2))


def fingerprint(text: bytes) -> int:
    """64 majority bits of the hashes of the text's shingles, as an unsigned number; 0 for no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        first = [0, *(ends[:-WORDS] + 1).tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, ends[WORDS - 1 :].tolist())]
    set_bits = np.zeros(64, dtype=np.int64)
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for start in range(0, len(octets), 1 << 16):
        set_bits += np.unpackbits(octets[start : start + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, text: str = "text", name: str = "__fingerprint") -> DataFrame:
    """The documents with the fingerprint as a long (its unsigned value modulo 2^64)."""
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            values = np.array([fingerprint(t) for t in blobs(batch, text)], dtype=np.uint64)
            yield append_columns(batch, **{name: pa.array(values.view(np.int64))})

    return documents.mapInArrow(run, schema)


class BKTree:
    """Integers in a tree whose edges carry the Hamming distance between parent and child."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Number of the node that holds ``value``; an equal value is not added again."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        node = 0
        while distance := (value ^ self.values[node]).bit_count():
            child = self.children[node].get(distance)
            if child is None:
                self.children[node][distance] = child = len(self.values)
                self.values.append(value)
                self.children.append({})
                return child
            node = child
        return node

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes whose values differ from ``value`` in at most ``radius`` bits."""
        found, open_ = [], [0] if self.values else []
        while open_:
            node = open_.pop()
            distance = (value ^ self.values[node]).bit_count()
            if distance <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    open_.append(child)
        return found


def linked(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join exactly the values that are linked directly or over others within the list."""
    tree = BKTree()
    root: list[int] = []
    edges = []

    def top(node: int) -> int:
        while root[node] != node:
            root[node] = root[root[node]]
            node = root[node]
        return node

    for value in values:
        near = tree.within(value, radius)
        node = tree.add(value)
        if node == len(root):
            root.append(node)
        for other in near:
            a, b = top(node), top(other)
            if a != b:
                root[a] = b
                edges.append((value, tree.values[other]))
    return edges


def _edges_of_shards(radius: int):
    """Arrow function over rows of (shard, value) that are sorted by shard: the edges within each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        key = None

        def edges_of(parts: list[np.ndarray]) -> pa.RecordBatch | None:
            values = np.concatenate(parts) if parts else np.empty(0, np.int64)
            if len(values) < 2:
                return None
            edges = linked(values.view(np.uint64).tolist(), radius)
            if not edges:
                return None
            a, b = np.array(edges, dtype=np.uint64).view(np.int64).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            value = batch.column("value").to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            bounds = [0, *cuts.tolist(), len(shard)]
            for start, end in zip(bounds[:-1], bounds[1:]):
                if start == end:
                    continue
                if shard[start] != key:
                    if (out := edges_of(pending)) is not None:
                        yield out
                    key, pending = shard[start], []
                pending.append(value[start:end])
        if (out := edges_of(pending)) is not None:
            yield out

    return run


def _shard_keys(value: Column, bits: int, start: Column) -> Column:
    """Six keys: which two of four blocks of ``bits`` bits, with their content, mixed with ``start``."""
    mask = (1 << bits) - 1
    block = [F.shiftrightunsigned(value, k * bits).bitwiseAND(F.lit(mask)) for k in range(4)]
    return F.array(*[F.xxhash64(start, F.lit(k), block[a], block[b]) for k, (a, b) in enumerate(_PAIRS)])


def _free_bits(value: Column, pair: Column) -> Column:
    """The 32 bits outside the pair of 16-bit blocks, as one number."""
    out = F.lit(0).cast("long")
    for k, chosen in enumerate(_PAIRS):
        low, high = [j for j in range(4) if j not in chosen]
        part = [F.shiftrightunsigned(value, 16 * j).bitwiseAND(F.lit(0xFFFF)) for j in (low, high)]
        out = F.when(pair == k, part[0].bitwiseOR(F.shiftleft(part[1], 16))).otherwise(out)
    return out


def near_edges(distinct: DataFrame, value: str, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b) edges between distinct fingerprints that give the same components as all links would."""
    zero = F.lit(0).cast("long")
    spread = distinct.select(F.col(value).alias("value")).select(
        "value", F.posexplode(_shard_keys(F.col("value"), 16, zero)).alias("pair", "shard")
    )
    spread = stage(spread, "shards")
    sizes = spread.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = spread.join(sizes, "shard")
    large = shared.where(F.col("n") > shard_limit).select(
        "value",
        F.explode(_shard_keys(_free_bits(F.col("value"), F.col("pair")), 8, F.col("shard"))).alias("shard"),
    )
    every = shared.where(F.col("n") <= shard_limit).select("value", "shard").unionByName(large)
    return (
        every.repartition("shard")
        .sortWithinPartitions("shard", "value")
        .mapInArrow(_edges_of_shards(RADIUS), "a long, b long")
    )


def classes(fingerprinted: DataFrame, key: str = "doc_id", name: str = "__fingerprint") -> DataFrame:
    """One row for each distinct fingerprint: itself, the root fingerprint of its class, the least key of the class.

    A NULL key counts as larger than any other. Rows without words have fingerprint zero, and are linked like any other.
    """
    distinct = stage(fingerprinted.groupBy(name).agg(F.min(key).alias("__key")), "fingerprints")
    roots = connected(near_edges(distinct, name))
    rooted = distinct.join(roots, distinct[name] == roots["node"], "left").select(
        name, "__key", F.coalesce("root", F.col(name)).alias("__root")
    )
    least = rooted.groupBy("__root").agg(F.min("__key").alias("__component"))
    return rooted.drop("__key").join(least, "__root")


def find_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint in hexadecimal, component_id) for each document, repeated rows included.

    NULL and empty texts get fingerprint zero; they form one class. ``component_id`` is the least key of all documents
    that are reached over links. An empty table gives an empty one.
    """
    marked = stage(fingerprints(documents.select(key, text), text).drop(text), "fingerprints")
    return marked.join(classes(marked, key), "__fingerprint").select(
        key,
        F.lower(F.lpad(F.hex("__fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("__component").alias("component_id"),
    )


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with its own columns: the one with the least key.

    Of rows with the same key and fingerprint the least (by all columns) stays, so equal rows leave one.
    """
    marked = stage(fingerprints(documents, text), "fingerprints")
    ids = marked.select(key, "__fingerprint").distinct()
    grouped = ids.join(classes(ids, key), "__fingerprint")
    first = grouped.groupBy("__root").agg(
        F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("__fingerprint").alias("f"))).alias("least")
    )
    kept = first.select(F.col("least.k").alias("__k"), F.col("least.f").alias("__f"))
    joined = marked.join(
        kept, (marked["__fingerprint"] == kept["__f"]) & marked[key].eqNullSafe(kept["__k"]), "left_semi"
    )
    row = F.struct(*[joined[c] for c in documents.columns])
    order = F.struct(*[joined[c] for c, kind in documents.dtypes if "map<" not in kind and "variant" not in kind])
    return joined.groupBy(key, "__fingerprint").agg(F.min_by(row, order).alias("row")).select("row.*")
