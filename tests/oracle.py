"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def _cell(v):
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_cell, v)) + "]"
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    # a column of whole numbers with nulls comes as floats from one side only
    return list(df.columns), sorted(tuple(_cell(int(v) if isinstance(v, float) and v == v and abs(v) < 1e15 and v == int(v) else v) for v in r) for r in df.itertuples(index=False, name=None))


def same(spark, queries, sqls, name, con, sf=SF):
    got, want = rows(queries[name](spark, sf).toPandas()), rows(con.execute(sqls[name]).df())
    assert got == want, name
