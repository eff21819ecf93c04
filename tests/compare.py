"""Run registered queries against their SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def rows(df):
    """Order-insensitive rows with columns by name, floats rounded."""
    names = sorted(df.columns)

    def plain(x):
        if pd.isna(x):
            return None
        if isinstance(x, float):
            return float(f"{x:.9g}")
        return int(x) if type(x).__name__.startswith("int") else str(x)

    return names, sorted((tuple(plain(x) for x in r) for r in df[names].astype(object).itertuples(index=False)), key=str)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        path = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df()
