"""Registering a column function as a query over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from tidemark.registry import query

KEYS = {
    "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "supplier": "s_suppkey",
    "nation": "n_nationkey", "events": "event_id", "documents": "doc_id", "pages": "page_id",
    "embeddings": "vec_id",
}


def project(name: str, table: str, sql: str | None, column: Callable[[], Column]) -> None:
    """``SELECT key, f(..) AS v FROM table``; ``column`` makes the expression in a session."""
    key = KEYS[table]
    text = None if sql is None else f"SELECT {key}, {sql} AS v FROM {table}"
    query(name, text)(lambda t: getattr(t, table).select(key, column().alias("v")))
