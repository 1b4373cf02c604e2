"""Comparison of queries with their SQL twins."""

import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd


def connection(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def counted(frame):
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return ""
        return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)

    return list(frame.columns), Counter(tuple(text(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def assert_same(spark, sf, query, sql):
    got_columns, got = counted(query(spark, sf).toPandas())
    want_columns, want = counted(connection(sf).sql(sql).df())
    assert got_columns == want_columns
    assert not got - want, f"only in the query: {list((got - want).items())[:3]}"
    assert not want - got, f"only in the SQL: {list((want - got).items())[:3]}"
