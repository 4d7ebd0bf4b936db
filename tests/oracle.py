"""Holds a registered query against its SQL twin in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(cell(row[k]) for k in order) for row in found), key=repr)


def same(df, sf_dir: str, sql: str) -> None:
    twin = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(twin.columns, twin.fetchall())
