"""Runs a query on Spark and its SQL on DuckDB and compares rows, ignoring their order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype
        if pd.api.types.is_datetime64_any_dtype(kind):
            df[c] = pd.to_datetime(df[c]).dt.tz_localize(None) if getattr(df[c].dt, "tz", None) else df[c]
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(kind) or pd.api.types.is_numeric_dtype(kind):
            df[c] = df[c].astype("float64").round(5) + 0.0
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else [str(x) for x in v] if hasattr(v, "__len__") and not isinstance(v, str) else v).astype(str)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    a, b = _plain(got), _plain(want)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            bad = ~(((a[c] - b[c]).abs() <= 2e-5 * (1 + b[c].abs())) | (a[c].isna() & b[c].isna()))
        else:
            bad = a[c].astype(str) != b[c].astype(str)
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {bad.sum()} of {len(a)} differ, first {a.loc[i].to_dict()} and {b.loc[i].to_dict()}"
    return ""
