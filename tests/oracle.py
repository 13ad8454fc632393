"""Compares a query with its SQL, run by DuckDB on the same tables."""

import decimal
import glob
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted([plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in columns]).collect())
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    theirs = sorted([plain(r[names.index(c)]) for c in columns] for r in got.fetchall())
    assert ours == theirs
