"""Rows of a Spark query against those of the SQL in DuckDB on the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(spark, con, sf: str, name: str, queries: dict, oracle: dict) -> list[str]:
    df = queries[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    found = con.execute(oracle[name])
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(columns)}"]
    want = rows_of(columns, found.fetchall())
    return [f"{sum(got.values())} and {sum(want.values())} rows", *(f"only Spark: {x}"[:300] for x in list(got - want)[:2]), *(f"only SQL: {x}"[:300] for x in list(want - got)[:2])] if got != want else []
