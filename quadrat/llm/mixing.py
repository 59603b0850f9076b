"""Mixing sources to target weights by entropy balancing.

Each source gets a token target. Document rates start even and are tilted exponentially by document length, within
0 and ``CAP`` copies: rate = CAP / (1 + exp(-tilt * size / mean size)). The tilts are the solution of a convex dual, one
unknown for each source, found by Newton steps whose sums are taken over all documents; as documents of equal size and
source share a rate, the sums run over counts by (source, size). Rates are then rounded into copies, from the longest
documents of a source to its shortest, and the words that rounding leaves over are carried on to the next size.

All sums that decide a rate are sums of whole numbers, so reruns agree whatever the order of the rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.staging import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
_SCALE = 1 << 32
_BUCKETS = 4096
_STEPS = 100


def word_count(text: str) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, at most ``cap`` times a source's own.

    ``sizes`` has source, size and n (documents of that size). Sources are numbered by code point, NULL last, which takes the table
    of distinct sources (not of documents) through one task.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stage(
        totals.withColumn("weight", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))),
        "sources",
    )
    budget = weighed.agg(F.sum("source_size")).first()[0]
    if budget is None:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"))
    budget, level, met = budget * share, 0.0, -1
    while True:  # each round fills sources up to the level that the others' weights leave
        full = F.col("weight") * level >= F.col("source_size") * cap
        filled, rest, count = weighed.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count_if(full),
        ).first()
        if count == met or not rest:
            break
        met, level = count, (budget - filled) / rest
    target = F.least(F.col("weight") * level, (F.col("source_size") * cap).cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def _rate(tilt: Column, cap: int) -> Column:
    """Copies of a document, in parts of ``_SCALE``."""
    z = F.col("size") * F.col("docs") / F.greatest(F.col("source_size"), F.lit(1))
    return F.round(F.lit(cap * _SCALE) / (F.lit(1.0) + F.exp(-F.greatest(F.least(tilt * z, F.lit(500.0)), F.lit(-500.0)))))


def solve_tilts(sizes: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, docs, tilt): Newton steps on the dual, kept inside a bracket that halves otherwise.

    A source is settled when its expected words are within one part in 10^5 of the target, half a word, or what one step of the rates
    changes. From then on, and after ``_STEPS`` steps at the latest, its tilt stays; ``round_copies`` takes in what is left of the gap.
    """
    docs = sizes.groupBy("source").agg(F.sum("n").alias("docs"))
    state = stage(
        targets.join(docs, targets["source"].eqNullSafe(docs["source"]))
        .select(targets["source"], "source_size", "target", "docs")
        .withColumns({"tilt": F.lit(0.0), "low": F.lit(-(2.0**30)), "high": F.lit(2.0**30), "done": F.lit(False)}),
        "tilts",
    )
    z = F.col("size") * F.col("docs") / F.greatest(F.col("source_size"), F.lit(1))
    for _ in range(_STEPS):
        joined = sizes.join(
            state.where(~F.col("done")), sizes["source"].eqNullSafe(state["source"])
        ).select(state["source"].alias("source"), "size", "n", "docs", "source_size", "tilt")
        rate = _rate(F.col("tilt"), cap).cast("long")
        slope = F.round(rate * (1 - rate / (cap * _SCALE)) * z).cast("decimal(38,0)")
        sums = joined.groupBy("source").agg(
            (F.sum((F.col("size") * F.col("n")).cast("decimal(38,0)") * rate) / _SCALE).cast("double").alias("words"),
            (F.sum((F.col("size") * F.col("n")).cast("decimal(38,0)") * slope) / _SCALE).cast("double").alias("slope"),
        )
        gap = F.col("target") - F.col("words")
        low = F.when(gap > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") + gap / F.greatest(F.col("slope"), F.lit(1e-9))
        inside = (step > low) & (step < high)
        near = F.abs(gap) <= F.greatest(F.col("target") * 1e-5, F.lit(0.5), F.col("source_size") / _SCALE)
        s = sums.select(F.col("source").alias("__s"), "words", "slope")
        moved = state.join(s, state["source"].eqNullSafe(s["__s"]), "left").select(
            "source",
            "source_size",
            "target",
            "docs",
            F.when(F.col("done") | near, F.col("tilt")).when(inside, step).otherwise((low + high) / 2).alias("tilt"),
            low.alias("low"),
            high.alias("high"),
            (F.col("done") | near).alias("done"),
        )
        state = stage(moved, "tilts")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", "source_size", "target", "docs", "tilt")


def round_copies(cells: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, base, extra): copies of every document of a cell, and how many of them get one more.

    ``cells`` has source, size, n, rate and the source's target; one task walks the distinct sizes of a source. What the rates leave of the target
    is shared out like the words that rounding leaves.
    """

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending")])
        cells = list(zip(*(table.column(c).to_pylist() for c in ("size", "n", "rate"))))
        carry = table.column("target")[0].as_py() - sum(size * n * int(rate) for size, n, rate in cells) / _SCALE
        base, extra = [], []
        for size, n, rate in cells:
            wanted = carry + size * n * int(rate) / _SCALE
            copies = min(max(round(wanted / size), 0), cap * n) if size else 0
            carry = wanted - copies * size
            base.append(copies // n)
            extra.append(copies % n)
        return pa.table(
            {
                "source": table.column("source").cast(pa.string()),
                "size": table.column("size"),
                "n": table.column("n"),
                "base": pa.array(base, pa.int64()),
                "extra": pa.array(extra, pa.int64()),
            }
        )

    return cells.groupBy("source").applyInArrow(walk, "source string, size long, n long, base long, extra long")


def mix(
    documents: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", size: Column | None = None
) -> DataFrame:
    """The documents with ``__size``, ``__source_size``, ``__target`` and ``__copies`` (0, 1 or 2).

    Documents of equal size and source differ by one copy at most; which of them get one more is decided by a hash of the id.
    NULL and empty texts have size 0 and no copies; NULL is a source of its own and the last; repeated
    rows are rows of their own; other columns stay as they are; an empty table gives an empty one. ``size`` may be given
    where ``documents`` holds no text.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit(7))
    rows = stage(
        documents.withColumns(
            {
                "__size": word_count(text) if size is None else size,
                "__source": F.col(source),
                "__order": order,
                "__bucket": F.shiftrightunsigned(order, 52).bitwiseXOR(F.lit(_BUCKETS // 2).cast("long")),
            }
        ),
        "mix",
    )
    sizes = stage(
        rows.groupBy(F.col("__source").alias("source"), F.col("__size").alias("size")).agg(F.count("*").alias("n")), "sizes"
    )
    tilts = solve_tilts(sizes, source_targets(sizes))
    cells = sizes.join(tilts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).withColumn(
        "rate", _rate(F.col("tilt"), CAP)
    )
    rounded = round_copies(cells.select("source", "size", "n", "rate", "target"))
    t = tilts.select(F.col("source").alias("__t"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    cell = stage(
        rounded.join(t, F.col("source").eqNullSafe(F.col("__t"))).select(
            F.col("source").alias("__cs"), F.col("size").alias("__cz"), F.col("base").alias("__base"), F.col("extra").alias("__extra"), "__source_size", "__target"
        ),
        "cells",
    )
    placed = rows.join(cell, F.col("__source").eqNullSafe(F.col("__cs")) & (F.col("__size") == F.col("__cz")))
    split = placed.where(F.col("__extra") > 0)
    # Ids of a cell in hash order, by buckets of the hash: only a bucket in which the extra copies run out is ranked.
    counts = split.groupBy("__cs", "__cz", "__bucket").agg(F.count("*").alias("__m"), F.first("__extra").alias("__x"))
    upto = Window.partitionBy("__cs", "__cz").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = counts.withColumn("__before", F.coalesce(F.sum("__m").over(upto), F.lit(0))).select(
        F.col("__cs").alias("__ls"),
        F.col("__cz").alias("__lz"),
        F.col("__bucket").alias("__lb"),
        F.greatest(F.col("__x") - F.col("__before"), F.lit(0)).alias("__left"),
        "__m",
    )
    joined = split.join(
        left, F.col("__cs").eqNullSafe(F.col("__ls")) & (F.col("__cz") == F.col("__lz")) & (F.col("__bucket") == F.col("__lb"))
    )
    columns = [*documents.columns, "__size", "__source_size", "__target"]
    even = placed.where(F.col("__extra") == 0).select(*columns, F.col("__base").alias("__copies"))
    whole = joined.where((F.col("__left") == 0) | (F.col("__left") >= F.col("__m"))).select(
        *columns, (F.col("__base") + (F.col("__left") > 0).cast("long")).alias("__copies")
    )
    within = Window.partitionBy("__cs", "__cz", "__bucket").orderBy("__order", key)
    part = (
        joined.where((F.col("__left") > 0) & (F.col("__left") < F.col("__m")))
        .withColumn("__place", F.row_number().over(within))
        .select(*columns, (F.col("__base") + (F.col("__place") <= F.col("__left")).cast("long")).alias("__copies"))
    )
    return even.unionByName(whole).unionByName(part)


def mix_documents(documents: DataFrame) -> DataFrame:
    """Digest of the mix, one row for each document."""
    narrow = documents.select("doc_id", "source", word_count("text").alias("__words"))
    mixed = mix(narrow, size=F.col("__words"))
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def draw(documents: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it was given copies, with its own columns."""
    mixed = mix(documents).where(F.col("__copies") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return mixed.withColumn("__copy", copies).select(*[mixed[c] for c in documents.columns])
