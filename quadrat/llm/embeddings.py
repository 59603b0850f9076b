"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells.

Cell centres are fitted on a sample of at most ``SAMPLE`` vectors; every vector is then assigned to its nearest centre, and also to
each centre whose cosine is within ``MARGIN`` of the nearest one, so that pairs on both sides of a border meet. Within a label and cell,
vectors are dealt into blocks of about ``BLOCK`` by a hash, and each pair of blocks is one matrix product in double precision. A pair that
meets in several cells counts in the least of them only. A product returns a number of links and one edge for each vector, never pairs.
The number of cells follows the number of vectors up to ``MAX_CELLS``, beyond which cells have more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.components import connected
from quadrat.operators.staging import stage

THRESHOLD = 0.93
MARGIN = 0.1
SAMPLE = 65_536
CELL_ROWS = 1024
MAX_CELLS = 4096
BLOCK = 1024
_ROUNDS = 8


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / np.where(largest > 0, largest, 1.0)  # squares of tiny and huge components stay finite
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(vectors: np.ndarray, cells: int, rounds: int = _ROUNDS) -> np.ndarray:
    """Unit centres; the first ``cells`` distinct vectors are the start, so equal input gives equal centres."""
    vectors = unit_rows(vectors)
    _, first = np.unique(vectors, axis=0, return_index=True)
    centres = vectors[np.sort(first)[:cells]].copy()
    for _ in range(rounds):
        nearest = np.concatenate(
            [np.argmax(vectors[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(vectors), 4096)]
        )
        order = np.argsort(nearest, kind="stable")
        starts = np.searchsorted(nearest[order], np.arange(len(centres)))
        filled = np.flatnonzero(np.bincount(nearest, minlength=len(centres)))
        sums = np.add.reduceat(vectors[order], starts[filled], axis=0)
        norms = np.linalg.norm(sums, axis=1)
        good = norms > 1e-12
        centres[filled[good]] = sums[good] / norms[good, None]
    return centres


def _valid(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray | None]:
    """Each vector, or None where it is NULL, empty, zero, or holds NULL or non-finite components."""
    out = []
    for item in column:
        v = np.array(item.as_py(), dtype=np.float64) if item.is_valid else None  # NULL components become NaN
        out.append(v if v is not None and v.size and np.isfinite(v).all() and v.any() else None)
    return out


def fit_centres(vectors: DataFrame, embedding: str, row: str) -> np.ndarray | None:
    """Centres of the commonest vector length, fitted on the rows with the least hashes; None without vectors."""
    count = vectors.where(F.size(embedding) > 0).count()
    if not count:
        return None
    sample = vectors.where(F.size(embedding) > 0).select(embedding, F.xxhash64(row, F.lit(5)).alias("h"))
    if count > SAMPLE:
        sample = sample.where(F.col("h") < int(-(2**63) + 2**64 * (SAMPLE / count)))
    drawn = [v for v in _valid(sample.orderBy("h").toArrow().column(embedding)) if v is not None]
    if not drawn:
        return None
    sizes, counts = np.unique([len(v) for v in drawn], return_counts=True)
    size = sizes[np.argmax(counts)]
    cells = min(MAX_CELLS, max(1, -(-count // CELL_ROWS)))
    return spherical_kmeans(np.array([v for v in drawn if len(v) == size]), cells)


def assign(vectors: DataFrame, label: str, embedding: str, row: str, centres: np.ndarray, margin: float) -> DataFrame:
    """(label, size, row, cells, vector bytes) of the vectors that can link."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # at most MAX_CELLS centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                found = _valid(batch.column(embedding))
                live = [k for k, v in enumerate(found) if v is not None]
                if not live:
                    continue
                cells: list[list[int]] = [[0] for _ in live]
                same = [n for n, k in enumerate(live) if len(found[k]) == centre.shape[1]]
                if same:
                    cosine = unit_rows(np.array([found[live[n]] for n in same])) @ centre.T
                    near = cosine >= cosine.max(axis=1, keepdims=True) - margin
                    for n, mask in zip(same, near):
                        cells[n] = np.flatnonzero(mask).tolist()
                take = pa.array(live)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(label).take(take).cast(pa.string()),
                        pa.array([len(found[k]) for k in live], pa.int32()),
                        batch.column(row).take(take),
                        pa.array(cells, pa.list_(pa.int32())),
                        pa.array([found[k].tobytes() for k in live], pa.binary()),
                    ],
                    names=["label", "size", "row", "cells", "vector"],
                )

    known = vectors.where(F.col(label).isNotNull()).select(label, embedding, row)
    return known.mapInArrow(run, "label string, size int, row long, cells array<int>, vector binary")


def links_of_blocks(table: pa.Table, threshold: float) -> pa.Table:
    """(row, links, root) of the linked rows of a pair of blocks; ``first`` and ``second`` are the blocks, ``block`` is a row's own."""
    rows = table.column("row").to_numpy()
    order = np.argsort(rows, kind="stable")
    table, rows = table.take(pa.array(order)), rows[order]
    cell, one, two = (table.column(c)[0].as_py() for c in ("cell", "first", "second"))
    vectors = unit_rows(np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(rows), -1))
    lists = table.column("cells").to_pylist()
    cells = np.full((len(rows), max(map(len, lists))), -1)
    for k, c in enumerate(lists):
        cells[k, : len(c)] = c
    earlier = np.where(cells < cell, cells, -1)  # a pair that shares one of these has counted there
    block = table.column("block").to_numpy()
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    links = np.zeros(len(rows), dtype=np.int64)
    root = np.arange(len(rows))

    def top(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for start in range(0, len(left), 256):
        part = left[start : start + 256]
        i, j = np.nonzero(vectors[part] @ vectors[right].T >= threshold)
        i, j = part[i], right[j]
        if one == two:
            i, j = i[i < j], j[i < j]
        shared = np.zeros(len(i), dtype=bool)
        for column in earlier.T:
            if (column >= 0).any():
                shared |= ((earlier[j] == column[i][:, None]) & (column[i] >= 0)[:, None]).any(axis=1)
        i, j = i[~shared], j[~shared]
        np.add.at(links, i, 1)
        np.add.at(links, j, 1)
        for a, b in zip(i.tolist(), j.tolist()):
            if root[a] != root[b]:
                a, b = top(a), top(b)
                root[max(a, b)] = min(a, b)
    live = np.flatnonzero(links)
    roots = np.array([rows[top(n)] for n in live.tolist()], dtype=np.int64)
    return pa.table({"row": rows[live], "links": links[live], "root": roots})


def find_near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
    block: int = BLOCK,
) -> DataFrame:
    """The rows with ``__links``, ``__component`` (least key reached) and ``__kept`` (one row of each component).

    Only vectors of equal, non-NULL labels and equal length are compared. Vectors that are NULL, empty or zero or hold NULL or non-finite
    components link with nothing, and so do rows without a label. Repeated rows are vectors of their own; of rows with the same least
    key one is kept; a NULL key counts as the largest. Other columns stay as they are; an empty table gives an empty one.
    """
    rows = stage(vectors.withColumn("__row", F.monotonically_increasing_id()), "vectors")
    narrow = rows.select(F.col(label).alias("__label"), F.col(embedding).alias("__vector"), "__row")
    centres = fit_centres(narrow, "__vector", "__row")
    if centres is None:
        centres = np.ones((1, 1))
    assigned = stage(assign(narrow, "__label", "__vector", "__row", centres, margin), "cells")
    spread = assigned.withColumn("cell", F.explode("cells"))
    sizes = spread.groupBy("label", "size", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / block).cast("int")
    paired = (
        spread.join(sizes, ["label", "size", "cell"])
        .withColumn("block", F.pmod(F.xxhash64("row", F.lit(3)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
        .select("label", "size", "cell", "first", "second", "block", "row", "cells", "vector")
    )
    # Dealt by the pair of blocks: the join above may leave all pairs of a cell in one task.
    keys = ["label", "size", "cell", "first", "second"]
    found = stage(
        paired.repartition(*keys).groupBy(*keys).applyInArrow(
            lambda table: links_of_blocks(table, threshold), "row long, links long, root long"
        ),
        "links",
    )
    totals = found.groupBy(F.col("row").alias("__linked")).agg(F.sum("links").alias("__n"))
    roots = connected(found, "row", "root").select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    joined = (
        rows.join(totals, F.col("__row") == F.col("__linked"), "left")
        .join(roots, F.col("__row") == F.col("__node"), "left")
        .withColumn("__root", F.coalesce("__root", "__row"))
    )
    least = (
        joined.groupBy(F.col("__root").alias("__top"))
        .agg(F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("__row").alias("r"))).alias("__least"))
    )
    return joined.join(least, F.col("__root") == F.col("__top")).select(
        *vectors.columns,
        F.coalesce("__n", F.lit(0)).cast("long").alias("__links"),
        F.col("__least.k").alias("__component"),
        (F.col("__row") == F.col("__least.r")).alias("__kept"),
    )
