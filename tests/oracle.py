"""Holds a query against its DuckDB statement on the same files."""

from __future__ import annotations

import glob

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        files = sorted(glob.glob(f"{sf_dir}/{t}.parquet/*")) or [f"{sf_dir}/{t}.parquet"]
        con.execute(f"create view {t} as select * from read_parquet({files!r})")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    text = df.astype(object).where(df.notna(), None).map(lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v))
    return df.loc[text.sort_values(list(text.columns)).index].reset_index(drop=True)


def assert_same(spark_side: pd.DataFrame, sql_side: pd.DataFrame) -> None:
    a, b = ordered(spark_side), ordered(sql_side)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6, rtol=1e-9)
