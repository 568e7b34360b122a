"""Comparison of a query with its SQL, run by DuckDB on the same files."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def plain(x):  # noqa: ANN001, ANN201
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, bytearray):
        return bytes(x)
    if isinstance(x, list):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    return x


def bag(columns: list[str], rows) -> Counter:  # noqa: ANN001
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {p.stem} as select * from read_parquet('{where}')")
    got = c.execute(sql)
    return [x[0] for x in got.description], got.fetchall()


def differences(df, folder: str, sql: str) -> tuple[list, list]:  # noqa: ANN001
    """Rows only Spark has, rows only the SQL has."""
    names, rows = duck(folder, sql)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    a, b = bag(df.columns, df.collect()), bag(names, rows)
    return list((a - b).elements()), list((b - a).elements())
