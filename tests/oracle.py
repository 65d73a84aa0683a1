"""Compares a DataFrame with DuckDB's rows for the same tables."""

import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(columns, found):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


def same(df, sql, sf_dir):
    got = rows(df.columns, df.collect())
    told = tables(sf_dir).sql(sql)
    assert got == rows(told.columns, told.fetchall())
