"""Comparing a query with its DuckDB twin, without regard to the order of rows."""

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(data=DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(int(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v):.6g}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in frame.itertuples(index=False))


def same(spark_frame, duck_frame):
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    a, b = rows(spark_frame), rows(duck_frame)
    assert len(a) == len(b)
    assert a == b
