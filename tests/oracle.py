"""Runs a query's SQL in DuckDB over the same tables and compares order-free, column by column."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)
    return [columns[i] for i in order], sorted(tuple(show(row[i]) for i in order) for row in rows)


def assert_same(df, sf_dir: str, sql: str) -> None:
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(*duck(sf_dir, sql))
