"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import os

import duckdb

DATA = os.environ.get("PALIMPSEST_TEST_DATA", "/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return repr(round(v, 9))
    return v


def rows(table) -> list[str]:
    names = sorted(table.column_names)
    return sorted(repr([_plain(r[c]) for c in names]) for r in table.select(names).to_pylist())


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def check(spark, query, sql: str | None, folder: str = DATA) -> None:
    got = query(spark, folder).toArrow()
    if sql is None:
        assert got.num_rows > 0 and all(got.column(c).null_count < got.num_rows for c in got.column_names if c != "data")
        return
    want = connect(folder).execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
