"""Sharding by histogram sort: shards of near equal bytes, cut at keys, with one exchange.

Rows are ordered by (hash of the text, id), so that equal texts lie next to each other. The cuts between
shards are found by counting: each round counts the exact bytes and rows below a set of candidate boundaries over
all partitions, takes a boundary that meets the tolerance and probes further inside the interval that holds the
target otherwise. Probes inside a text's own group are used only when its edges miss the tolerance, so a group of
equal texts stays in one shard unless it is too large for that. With the cuts known, rows are exchanged once.

A shard is cut into several ranges by the same counts, so that no task sorts a whole shard; the exact rows below
a range give its first slot. The driver sees counts only: at most 2^15 buckets, then 256 for each open interval.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.staging import stage

SHARDS = 24
OVERHEAD = 8
TOLERANCE = 0.01
RANGE_ROWS = 1_000_000
RANGE_BYTES = 16 << 20
MAX_RANGES = 512
_TOP = 15
_STEP = 8
#: The parts of a row's key, in the order of comparison; all are 63-bit numbers.
_KEY = ["__h", "__id", "__bit", "__row"]


@dataclass
class Cut:
    """A boundary: the least key on its right, and the bytes and rows on its left."""

    key: tuple[int, ...]
    bytes: int
    rows: int


def keyed(df: DataFrame, text_hash: Column, key: str) -> DataFrame:
    """The rows with the parts of their sort key; the last part tells repeated rows apart. NULL ids are the least."""
    number = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    return (
        df.withColumn("__h", F.shiftrightunsigned(text_hash, 1))
        .withColumn("__id", F.shiftright(number, 1))
        .withColumn("__bit", number.bitwiseAND(F.lit(1).cast("long")))
        .withColumn("__row", F.monotonically_increasing_id())
    )


def _counts(rows: DataFrame, size: str, *group: str) -> list:
    spread = [f(c).alias(f"{name}{c}") for c in _KEY for name, f in (("low", F.min), ("high", F.max))]
    return (
        rows.groupBy(*group)
        .agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"), *spread)
        .orderBy(*group)
        .collect()
    )


def _after(bucket) -> tuple[int, ...]:
    """The least key beyond a bucket, which holds one value in each part up to the first that spans several."""
    key = []
    for c in _KEY:
        key.append(bucket[f"high{c}"])
        if bucket[f"low{c}"] != bucket[f"high{c}"]:
            break
    return (*key[:-1], key[-1] + 1, *[-(2**62)] * (len(_KEY) - len(key)))


def _bucket() -> Column:
    """Number of the probe interval that a row falls in, from the joined columns of its open interval."""
    out = F.lit(None).cast("long")
    for level, part in enumerate(_KEY):
        step = F.expr(f"shiftrightunsigned({part} - low{part}, shift)")
        out = F.when(F.col("level") == level, step).otherwise(out)
    return out


def find_cuts(rows: DataFrame, size: str, targets: list[tuple[int, float]]) -> list[Cut]:
    """A cut for each (bytes below, tolerance in bytes); a cut that misses its tolerance lies beside one row."""
    cuts: dict[int, Cut] = {}
    open_: list[tuple[tuple, list[int]]] = []

    def settle(buckets: list, below_bytes: int, below_rows: int, wanted: list[int]) -> None:
        edges, at_bytes, at_rows = [], [below_bytes], [below_rows]
        for b in buckets:
            edges.append(tuple(b[f"low{c}"] for c in _KEY))
            at_bytes.append(at_bytes[-1] + b["bytes"])
            at_rows.append(at_rows[-1] + b["rows"])
        inside: dict[int, list[int]] = {}
        for t in wanted:
            goal, slack = targets[t]
            k = min(max(bisect_left(at_bytes, goal) - 1, 0), len(buckets) - 1)
            left, right = goal - at_bytes[k], at_bytes[k + 1] - goal
            near = k if left <= right else k + 1
            if min(left, right) > slack and buckets[k]["rows"] > 1:
                inside.setdefault(k, []).append(t)
            elif near < len(buckets):
                cuts[t] = Cut(edges[near], at_bytes[near], at_rows[near])
            else:
                cuts[t] = Cut(_after(buckets[-1]), at_bytes[near], at_rows[near])
        for k, ts in inside.items():
            b = buckets[k]
            level = next(j for j, c in enumerate(_KEY) if b[f"low{c}"] != b[f"high{c}"])
            span = b[f"high{_KEY[level]}"] - b[f"low{_KEY[level]}"]
            bounds = [b[f"{side}{c}"] for c in _KEY for side in ("low", "high")]
            for j in range(level + 1, len(_KEY)):
                bounds[2 * j : 2 * j + 2] = [-(2**62), 2**63 - 1]
            shift = max(0, span.bit_length() - _STEP)
            open_.append(((bounds[0] >> (63 - _TOP), bounds[1] >> (63 - _TOP), level, shift, at_bytes[k], at_rows[k], *bounds), ts))

    whole = rows.select(size, *_KEY).withColumn("__top", F.shiftrightunsigned("__h", 63 - _TOP))
    settle(_counts(whole, size, "__top"), 0, 0, list(range(len(targets))))
    names = [f"{side}{c}" for c in _KEY for side in ("low", "high")]
    while open_:
        current, open_ = open_, []
        table = [(n, *box[0:1], *box[2:4], *box[6:]) for n, (box, _) in enumerate(current)]
        boxes = rows.sparkSession.createDataFrame(
            table, "interval int, __top long, level int, shift int, " + ", ".join(f"{c} long" for c in names)
        )
        hits = whole.join(boxes, "__top").where(
            " AND ".join(f"{c} BETWEEN low{c} AND high{c}" for c in _KEY)
        )
        hits = hits.withColumn("bucket", _bucket()).select("interval", "bucket", size, *_KEY)
        found: dict[int, list] = {}
        for row in _counts(hits, size, "interval", "bucket"):
            found.setdefault(row["interval"], []).append(row)
        for n, (box, ts) in enumerate(current):
            settle(found[n], box[4], box[5], ts)
    return [cuts[t] for t in range(len(targets))]


def shard_by_bytes(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    range_rows: int = RANGE_ROWS,
    size: Column | None = None,
    text_hash: Column | None = None,
) -> DataFrame:
    """The rows with ``__size`` (UTF-8 bytes of the text and 8), ``__shard`` and ``__slot``.

    Shard sizes differ from the mean by at most twice ``tolerance`` of it, or by one row. Slots number a shard's rows
    from 0 on without gaps, in key order. NULL and empty texts have only the 8 bytes; repeated rows are kept, each with
    a slot of its own; an empty table gives an empty one; other columns stay as they are. A table with fewer rows than shards leaves
    some shards empty. ``size`` and ``text_hash`` may be given where ``df`` holds no text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(whole).cast("long") + OVERHEAD if size is None else size
    text_hash = F.xxhash64(whole) if text_hash is None else text_hash
    rows = stage(keyed(df.withColumn("__size", size), text_hash, key), "shards")
    total, count = rows.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    if not count:
        empty = rows.select(*df.columns, "__size")
        return empty.withColumn("__shard", F.lit(0)).withColumn("__slot", F.lit(0).cast("long"))
    pieces = min(MAX_RANGES, max(1, -(-count // (shards * range_rows)), -(-total // (shards * RANGE_BYTES))))
    targets = [
        (total * n / (shards * pieces), total / shards * (tolerance if n % pieces == 0 else 0.5 / pieces))
        for n in range(1, shards * pieces)
    ]
    cuts = find_cuts(rows, "__size", targets)
    shard_cuts = cuts[pieces - 1 :: pieces]
    # A loose inner cut may lie beyond a shard's own cut; ranges are what lies between the cuts in key order.
    bounds = sorted({c.key: c for c in cuts}.values(), key=lambda c: c.key)
    keys = [b.key for b in bounds]
    starts = [Cut((), 0, 0), *bounds]
    edges = [0, *[c.rows for c in shard_cuts]]
    ranges = []
    for n, start in enumerate(starts):
        shard = sum(c.key <= start.key for c in shard_cuts) if n else 0
        ranges.append((n, shard, start.rows - edges[shard]))
    spark = df.sparkSession
    first = spark.createDataFrame(ranges, "__range int, __shard int, __first long")
    top = [k[0] >> (63 - _TOP) for k in keys]
    table = []
    for bucket in range(1 << _TOP):
        low, high = bisect_left(top, bucket), bisect_left(top, bucket + 1)
        table.append((bucket, low, [keys[j] for j in range(low, high)]))
    fields = ",".join(f"{c}:bigint" for c in _KEY)
    lookup = spark.createDataFrame(table, f"__top long, __low int, __keys array<struct<{fields}>>")
    own = F.struct(*_KEY)
    placed = (
        rows.withColumn("__top", F.shiftrightunsigned("__h", 63 - _TOP))
        .join(F.broadcast(lookup), "__top")  # 2^15 rows at any input size
        .withColumn("__range", F.col("__low") + F.size(F.filter("__keys", lambda k: k <= own)))
    )
    order = Window.partitionBy("__range").orderBy(*_KEY)
    ranked = placed.withColumn("__place", F.row_number().over(order))
    return ranked.join(F.broadcast(first), "__range").select(  # one row for each range
        *df.columns, "__size", "__shard", (F.col("__first") + F.col("__place") - 1).cast("long").alias("__slot")
    )


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Digest of the shards of documents; only ids, sizes and checksums of the texts are exchanged."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id",
        F.crc32(text).alias("text_crc32"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("__bytes"),
        F.xxhash64(text).alias("__text_hash"),
    )
    sharded = shard_by_bytes(narrow, shards=shards, size=F.col("__bytes"), text_hash=F.col("__text_hash"))
    return sharded.select(
        "doc_id",
        F.col("__size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
