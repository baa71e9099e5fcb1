"""Runs queries and their SQL twins side by side and compares values exactly."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        raise TypeError("decimal in a portable result")
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return f"{type(v).__name__}:{v}"


def _sorted(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    names, want = _sorted([d[0] for d in result.description], result.fetchall())
    got_names, got = _sorted(df.columns, df.collect())
    if names != got_names:
        return f"columns {got_names} != {names}"
    if len(want) != len(got):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(n, x, y) for n, x, y in zip(names, g, w) if x != y]
        return f"{len(bad)} of {len(want)} rows differ, first: {cells[:4]}"
    return None
