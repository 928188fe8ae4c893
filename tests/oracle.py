"""Compare a query with its SQL statement run by DuckDB on the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _normal(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(df, sql: str, con) -> list[str]:
    """Empty when names, value types, row count and all values agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _normal(cursor.fetchall(), names)
    actual = _normal([tuple(r) for r in df.collect()], df.columns)
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    if len(actual) != len(expected):
        return [f"{len(actual)} rows instead of {len(expected)}"]
    for got, want in zip(actual, expected):
        if got != want or [type(g) for g in got] != [type(w) for w in want]:
            found.append(f"got {got}, want {want}")
    return found[:3] + ([f"{len(found)} rows differ of {len(actual)}"] if found else [])
