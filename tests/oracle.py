"""Comparison of a query's rows with those of its SQL text in DuckDB."""

from __future__ import annotations

import math
import re

import duckdb
from pyspark.sql import DataFrame

from tidemark.tables import NAMES

_SAME = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB",
}


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def duck_type(kind: str) -> str:
    if kind.startswith("array<"):
        return duck_type(kind[6:-1]) + "[]"
    if kind.startswith("decimal"):
        return kind.upper()
    return _SAME.get(kind, kind)


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value) if value == 0 else value  # zeros keep their sign
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    return value


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if rows, names and types agree, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    wanted_rows = found.fetchall()
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = [
        f"{n}: {k} != {kinds[n]}" for n, k in df.dtypes
        if re.sub(r"\s", "", duck_type(k)) != re.sub(r"\s", "", kinds[n])
    ]
    order = sorted(df.columns)
    got = sorted(
        (tuple(plain(r[c]) for c in order) for r in df.collect()), key=lambda r: tuple(map(repr, r))
    )
    places = [names.index(c) for c in order]
    wanted = sorted(
        (tuple(plain(r[p]) for p in places) for r in wanted_rows), key=lambda r: tuple(map(repr, r))
    )
    if wrong:
        return "types " + "; ".join(wrong)
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}; {order} first {got[:2]} / {wanted[:2]}"
    if not got:
        return "no rows on both sides"
    for g, w in zip(got, wanted):
        if g != w:
            return f"{order}: {g} != {w}"
    return None
