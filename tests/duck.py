"""Runs a query's SQL in DuckDB over the test tables, and compares rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd

SMALL, CHECKED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(_plain, v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else float(f"{v:.8g}")
    return v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


def sql_rows(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return rows(con.execute(sql).df())
