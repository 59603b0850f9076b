"""Folds over the ordered rows of each group, with no group in one task or in memory.

Rows are cut by range of (group, order) and sorted, so a task holds a stretch of the whole order: many small groups, or a part of a large one. A task walks its
batches and keeps one state, that of the group it is in. Groups that begin and end inside a task are finished there. The first and the last group of a task may go
on in a neighbour; their states, one or two for each task, are joined along the tasks in a second, small step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quadrat.operators.staging import stage

State = tuple


def group_starts(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """Rows of a sorted batch at which a group begins, row 0 included; NULLs are equal to each other."""
    n = batch.num_rows
    starts = np.zeros(n, dtype=bool)
    starts[0] = True
    for name in by:
        column = batch.column(name)
        a, b = column.slice(0, n - 1), column.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        starts[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(starts)


def fold_groups(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    of_run: Callable[[pa.RecordBatch], State],
    join: Callable[[State, State], State],
    state: str,
) -> DataFrame:
    """One row for each group: ``by`` and the columns of ``state`` (as in ``"n long, last string"``).

    ``of_run`` gives the state of some consecutive rows of a group, in ``order``; ``join`` the state of two runs of which the second follows the
    first, and must not depend on where a group is cut. Rows equal in ``by`` and ``order`` come in any order. NULLs in ``by`` make a group; an empty table gives none.
    """
    keys = df.select(*by).schema
    made = StructType.fromDDL(state)
    schema = StructType([*keys.fields, *made.fields]).add("_task", "integer")
    arrow = to_arrow_schema(schema)
    names = list(by)

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        key, held, first, done = None, None, True, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = [*group_starts(batch, names).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                mine = tuple(batch.column(c)[start].as_py() for c in names)
                run = of_run(batch.slice(start, stop - start))
                if key is not None and mine == key:
                    held = join(held, run)
                    continue
                if key is not None:
                    done.append((*key, *held, task if first else None))
                    first = False
                key, held = mine, run
            if len(done) > 10_000:
                yield rows_of(done)
                done = []
        if key is not None:
            done.append((*key, *held, task))
        if done:
            yield rows_of(done)

    def along(table: pa.Table) -> pa.Table:
        rows = table.sort_by("_task").to_pylist()
        total = tuple(rows[0][c] for c in made.names)
        for row in rows[1:]:
            total = join(total, tuple(row[c] for c in made.names))
        whole = (*(rows[0][c] for c in names), *total, None)
        return pa.Table.from_batches([rows_of([whole])])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    folded = stage(cut.mapInArrow(walk, schema), "folded")
    border = folded.where(F.col("_task").isNotNull()).groupBy(*by).applyInArrow(along, schema)
    return folded.where(F.col("_task").isNull()).unionByName(border).drop("_task")
