"""Side by side comparison of a query and its DuckDB oracle."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([cell(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    return repr(round(float(v), 6) + 0.0).removesuffix(".0") if isinstance(v, float) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))
