"""Comparison of a query with its SQL in DuckDB."""

import os
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return [_plain(x) for x in v.tolist()]
    return round(v + 0.0, 6) if isinstance(v, float) else v


def rows(df: pd.DataFrame) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr([str(x) if not isinstance(x := _plain(v), float) or not x.is_integer() else str(int(x)) for v in r]) for r in df[names].itertuples(index=False, name=None))


def check(spark, query, sql: str, folder: str) -> None:
    ours, theirs = query(spark, folder).toPandas(), connect(folder).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
