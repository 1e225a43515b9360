"""Comparison of a query with its SQL, run by DuckDB on the same files."""

import glob
import os

import duckdb
import pandas as pd


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    names = sorted(df.columns)
    return sorted(tuple(text(v) for v in row) for row in df[names].itertuples(index=False, name=None))


def assert_same(spark, sf: str, query, sql: str) -> None:
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want, got = con.sql(sql).df(), query(spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(got) == rows_of(want)
