"""Runs a query on Spark and its SQL on DuckDB and compares names and values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, decimal.Decimal)):
        return f"{float(x):.9g}" if isinstance(x, decimal.Decimal) else f"{x}" if abs(x) >= 10**9 else f"{float(x):.9g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def compare(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.select(*[f"`{c}`" for c in order]).collect())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{order}: {a} against {b}"
    return ""
