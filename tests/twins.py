"""Comparing a query with its DuckDB twin."""

import os

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata/sf0.001"


def database(folder=DATA):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, (np.ndarray, list, tuple)):
        return tuple(map(plain, x))
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (np.integer, np.bool_)):
        return x.item()
    return float(x) + 0.0 if isinstance(x, (float, np.floating)) else x


def rows(found, columns):
    order = sorted(columns)
    return sorted(repr(tuple(plain(r[columns.index(c)]) for c in order)) for r in found)


def same(df, sql, con):
    want = con.sql(sql)
    columns = list(want.columns)
    assert sorted(df.columns) == sorted(columns)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    expected = rows(want.fetchall(), columns)
    assert got == expected
    return len(got)
