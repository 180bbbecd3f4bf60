"""Runs registered queries beside their SQL in DuckDB and compares rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return int(x) if isinstance(x, int) else x


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[list[tuple], list[tuple]]:
    df = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns), (df.columns, want.columns)
    return rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
