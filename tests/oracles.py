"""Runs a query's SQL on DuckDB and compares rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    return ("nan" if math.isnan(v) else round(v, 8) + 0.0) if isinstance(v, float) else v


def rows_of(columns, rows, order):
    at = [list(columns).index(c) for c in order]
    return sorted((tuple(_norm(r[i]) for i in at) for r in rows), key=lambda r: tuple(map(str, r)))


def assert_same(df, con, sql):
    found = con.sql(sql)
    order = sorted(df.columns)
    assert sorted(found.columns) == order
    assert rows_of(df.columns, df.collect(), order) == rows_of(found.columns, found.fetchall(), order)
