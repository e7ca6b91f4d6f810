"""Comparison of a Spark result with DuckDB on the same files."""

from __future__ import annotations

import decimal
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def _text(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT:
        return "NULL"
    if isinstance(x, float | decimal.Decimal):
        return "NULL" if x != x else f"{float(x):.9g}"
    return str(x)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(_text, r)) for r in frame.itertuples(index=False))


def same(df, sql: str, folder: str) -> int:
    """Asserts that both have the same columns and rows; returns how many."""
    got, want = df.toPandas(), views(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)
