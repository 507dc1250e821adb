"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [_plain(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(r[i]) for i in order]) for r in data)


def duck(data_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(data_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def difference(spark, name, query, sql, data_dir):
    """None if both results are the same, else what differs."""
    df = query(spark, str(data_dir))
    a_cols, a = rows(df.columns, df.collect())
    cur = duck(data_dir).execute(sql)
    b_cols, b = rows([x[0] for x in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"{name}: columns {a_cols} and {b_cols}"
    if a != b:
        from collections import Counter

        ca, cb = Counter(a), Counter(b)
        return f"{name}: {len(a)} and {len(b)} rows; only Spark: {list((ca - cb).elements())[:3]}; only SQL: {list((cb - ca).elements())[:3]}"
    return None
