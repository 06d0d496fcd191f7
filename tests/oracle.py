"""Comparison of a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    rel = con.sql(sql)
    a, b = sorted(df.columns), sorted(rel.columns)
    if a != b:
        return f"columns {a} and {b}"
    x, y = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if x == y:
        return ""
    only_x, only_y = [r for r in x if r not in set(y)][:3], [r for r in y if r not in set(x)][:3]
    return f"{len(x)} and {len(y)} rows; only here {only_x}, only SQL {only_y}"
