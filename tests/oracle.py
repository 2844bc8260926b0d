"""Runs a query and its SQL over the same tables and compares the rows."""

import datetime
import math
import os

import duckdb


def connect(d):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(d)):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{d}/{f}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


def compare(df, con, sql):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    mine = sorted(tuple(plain(row[c]) for c in cols) for row in df.collect())
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert mine == theirs
