"""Run registered queries in Spark and DuckDB side by side.

    python -m quadrat.checks.oracle [sf_dir] [name ...] [quadrat.taskRows=500] [quadrat.pinRows=10]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _cell(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return "NULL"
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(arrow) -> list[tuple]:
    names = sorted(arrow.schema.names)
    columns = [[_cell(v) for v in arrow.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns))


def kinds_of(arrow) -> dict[str, str]:
    out = {}
    for f in arrow.schema:
        kind = str(f.type)
        out[f.name] = {"large_string": "string"}.get(kind, kind)
    return out


def differences(spark, con, sf: str, fn, sql: str) -> list[str]:
    """Empty when columns, types, row counts and values agree."""
    got = fn(spark, sf).toArrow()
    want = con.sql(sql).to_arrow_table()
    problems = []
    if sorted(got.schema.names) != sorted(want.schema.names):
        return [f"columns {sorted(got.schema.names)} != {sorted(want.schema.names)}"]
    a, b = kinds_of(got), kinds_of(want)
    for name in a:
        if a[name] != b[name]:
            problems.append(f"type of {name}: {a[name]} != {b[name]}")
    if got.num_rows != want.num_rows:
        problems.append(f"rows {got.num_rows} != {want.num_rows}")
    left, right = rows_of(got), rows_of(want)
    if left != right:
        only = sorted(set(left) - set(right))[:3]
        other = sorted(set(right) - set(left))[:3]
        problems.append(f"values ({sorted(got.schema.names)}): spark {only} sql {other}")
    if not got.num_rows:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    from quadrat.checks.registry import QUERIES
    from quadrat.session import build_session

    conf = dict(a.split("=", 1) for a in argv if "=" in a)
    argv = [a for a in argv if "=" not in a]
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8)
    for key, value in conf.items():
        spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in names:
        fn, sql = QUERIES[name]
        start = time.time()
        try:
            if sql:
                problems = differences(spark, con, sf, fn, sql)
            else:
                n = fn(spark, sf).toArrow().num_rows
                problems = [] if n else ["no rows"]
        except Exception as exc:  # noqa: BLE001 - report every query
            text = "".join(traceback.format_exception_only(exc)).strip()
            problems = [text[:1500]]
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok" if sql else "ok (rows only)")
        print(f"{mark:5} {name} {time.time() - start:.2f}s", *problems, sep="\n      " if problems else " ")
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
