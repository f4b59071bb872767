"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: x if x is None or isinstance(x, str) else str(list(x)) if hasattr(x, "__iter__") else x)
            if df[c].map(lambda x: x is None or isinstance(x, (bool, int, float)) or x is pd.NA).all():
                df[c] = df[c].map(lambda x: None if x is None or x is pd.NA else float(x)).astype(float)
        if df[c].dtype != object and not str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(float) + 0.0
        df[c] = df[c].astype(object).where(df[c].notna(), None)
    return df


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty if both are the same."""
    a, b = _plain(spark_df), _plain(sql_df)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    x = sorted(map(repr, a.itertuples(index=False, name=None)))
    y = sorted(map(repr, b.itertuples(index=False, name=None)))
    wrong = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
