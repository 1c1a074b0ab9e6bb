"""Compares a query's rows with its SQL twin's: sorted columns, order-free."""

from __future__ import annotations

import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return con


def _plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


def difference(spark, con, f, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    df = f(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = sorted(repr([_plain(dict(zip(names, r, strict=True))[n]) for n in order]) for r in cur.fetchall())
    ours = sorted(repr([_plain(r[n]) for n in order]) for r in df.collect())
    if ours == theirs:
        return ""
    a, b = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
    return f"{len(ours)} and {len(theirs)} rows; only ours: {a[:2]}; only theirs: {b[:2]}"
