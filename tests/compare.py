"""Rows of Spark and DuckDB in one canonical form."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for file in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _text(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float | decimal.Decimal):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(_text, x)) + "]"
    return f"{x:d}" if isinstance(x, int) else str(x)


def canonical(rows) -> list[tuple[str, ...]]:
    return sorted(tuple(map(_text, row)) for row in rows)
