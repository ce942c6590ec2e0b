"""Compares a query's rows with those of its SQL, regardless of order."""

import glob
import os
from functools import cache

import duckdb

FOLDER = "/root/testdata/sf0.001"


@cache
def database(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def shown(v) -> str:
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


def assert_same(df, sql: str, folder: str = FOLDER) -> None:
    found = database(folder).sql(sql)
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    ours = sorted(tuple(shown(r[n]) for n in names) for r in df.collect())
    at = [found.columns.index(n) for n in names]
    theirs = sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs
