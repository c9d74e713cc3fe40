"""Rows of a Spark query and of its SQL in another engine, side by side."""

from __future__ import annotations

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(rows: list) -> list:
    return sorted((tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=repr)


def both(spark, con, query, sql: str, folder: str = SMALL) -> tuple[list, list]:
    df = query(spark, folder)
    cols = sorted(df.columns)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    return plain([tuple(r) for r in df.select(*cols).collect()]), plain([tuple(r[i] for i in at) for r in found.fetchall()])
