"""Spark-vs-DuckDB comparison used by the tests (schema, row count,
order-insensitive value multiset)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

from jobsift.plans.binding import BASE_TABLES

SF_SMALL = "/root/testdata/sf0.001"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = False  # set by callers that want exact float comparison


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v) if STRICT else round(v, 4)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def _key(t):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 if not isinstance(x, tuple) else (False, "tuple", str(x)) for x in t)


def compare(df, con, sql):
    """Return None when equal, else a short description of the difference."""
    scols, srows = rows_of_spark(df)
    dcols, drows = rows_of_duck(con, sql)
    if scols != dcols:
        return f"columns differ: spark={scols} duck={dcols}"
    if len(srows) != len(drows):
        return f"row count differs: spark={len(srows)} duck={len(drows)}"
    s = sorted(srows, key=_key)
    d = sorted(drows, key=_key)
    for a, b in zip(s, d):
        if a != b:
            return f"first differing row: spark={a} duck={b}"
    return None
