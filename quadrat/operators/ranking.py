"""Exact row numbers within groups, with no task that holds a whole group.

A window function sends each group to one task, and one class or category may hold a third of all rows. ``ranked``
therefore cuts the rows by range of (group, order key) into chunks of even size, takes a row's position
within its sorted chunk, and adds the rows of its group in earlier chunks. The same plan serves every size; the number
of chunks is ``spark.sql.shuffle.partitions``. The order key must be unique inside a group for the result to be
deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.staging import stage

_POSITION_BITS = 33


def range_chunks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_chunk`` and ``_pos`` columns.

    The chunks are written out: range bounds come from sampling, so two evaluations of the same expression could
    cut at different keys.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = stage(cut.withColumn("_mid", F.monotonically_increasing_id()), "chunks")
    return (
        cut.withColumn("_chunk", F.shiftright("_mid", _POSITION_BITS).cast("int"))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_mid")
    )


def chunk_offsets(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (group, chunk): position of the group's first row and rows of it in earlier chunks.

    At most one row per chunk plus one per group, whatever the number of input rows.
    """
    heads = chunks.groupBy(*by, "_chunk").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = heads.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    return heads.drop("_rows")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], rn: str = "rn") -> DataFrame:
    """``df`` with ``rn``, the 1-based row number within ``by`` along ``order``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    chunks = range_chunks(df, [F.col(c) for c in by] + cols)
    keys = [*by, "_chunk"]
    offsets = stage(chunk_offsets(chunks, by), "offsets").select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first", "_before"
    )
    on = F.lit(True)
    for i, key in enumerate(keys):
        on = on & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    number = F.col("_pos") - F.col("_first") + F.col("_before") + 1
    return chunks.join(offsets, on).select(*df.columns, number.cast("long").alias(rn))


def exact_percentile(df: DataFrame, value: str, p: float) -> float | None:
    """Percentile with linear interpolation over all rows, without one task holding them all."""
    known = df.where(F.col(value).isNotNull()).select(value)
    chunks = range_chunks(known, [F.col(value)])
    sizes = dict(chunks.groupBy("_chunk").count().collect())  # one row for each chunk
    n = sum(sizes.values())
    if n == 0:
        return None
    at = (n - 1) * p
    low = int(at)
    wanted = {}
    for spot in (low, min(low + 1, n - 1)):
        rest = spot
        for chunk in sorted(sizes):
            if rest < sizes[chunk]:
                wanted[spot] = (chunk, rest)
                break
            rest -= sizes[chunk]
    places = F.lit(False)
    for chunk, position in wanted.values():
        places = places | ((F.col("_chunk") == chunk) & (F.col("_pos") == position))
    found = {(r["_chunk"], r["_pos"]): r[value] for r in chunks.where(places).collect()}
    first, second = (found[wanted[s]] for s in (low, min(low + 1, n - 1)))
    return first + (second - first) * (at - low)
