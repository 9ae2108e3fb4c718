"""A registered query against its DuckDB SQL: columns by name, rows as a bag."""

import glob
import os

import duckdb
import pandas as pd


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str([_value(x) for x in v]) if isinstance(v, (list, tuple)) else v


def bag(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_value, r)) for r in df.itertuples(index=False, name=None)), key=str)


def oracle(sql, sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c.execute(sql).df()


def check(spark, query, sql, sf):
    got, want = query(spark, sf).toPandas(), oracle(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)
