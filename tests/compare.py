"""Spark rows against DuckDB rows, column by column, in any order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal | int):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def near(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def differences(df, sql: str, sf_dir: str) -> str:
    names, want = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    at = [names.index(c) for c in order]
    key = lambda r: tuple((x is not None, str(type(x)), x if not isinstance(x, float) else round(x, 4)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want), key=key)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if not all(map(near, x, y))]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""
