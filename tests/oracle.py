"""Compares a query with its DuckDB twin: columns by name, rows as a bag, floats to nine digits."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return str(v)


def bags(query, twin, spark, sf_dir, con):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.sql(twin)
    assert sorted(res.columns) == cols
    at = [res.columns.index(c) for c in cols]
    return got, sorted(tuple(norm(r[i]) for i in at) for r in res.fetchall())
