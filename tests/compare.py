"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

import math
import os
from pathlib import Path

import duckdb
import pytest

DATA = Path(os.environ.get("PLYFORGE_TEST_DATA", "/root/testdata/sf0.001"))
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def rows_of_sql(sql):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted(got.columns), sorted(str([cell(r[i]) for i in order]) for r in got.fetchall())


def rows_of_query(df):
    names = sorted(df.columns)
    return names, sorted(str([cell(r[n]) for n in names]) for r in df.collect())
