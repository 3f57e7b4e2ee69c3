"""Run a registered query and its SQL on the same files and compare the results.

``python -m tests.compare [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, Decimal):
        return repr(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(actual: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both have the same columns and rows, else what differs."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(actual.columns):
        return f"columns {sorted(actual.columns)} != {sorted(names)}"
    want = _rows(names, found.fetchall())
    table = actual.toArrow()
    have = _rows(actual.columns, zip(*[c.to_pylist() for c in table.columns]) if table.num_columns else [])
    if len(want) != len(have):
        return f"{len(have)} rows, SQL has {len(want)}"
    for a, b in zip(have, want):
        if a != b:
            return f"{a} != {b}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from lumencat.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, oracle = local_session(8, "compare", "12g"), connect(sf_dir), oracle_sql()
    bad = 0
    for name in names:
        start = time.perf_counter()
        try:
            df = queries()[name](spark, sf_dir)
            problem = differences(df, con, oracle[name]) if name in oracle else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001 - the report goes on
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        bad += problem is not None
        print(f"{name:28s} {time.perf_counter() - start:7.2f}s  {problem or 'same'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} same")
    spark.stop()


if __name__ == "__main__":
    main()
