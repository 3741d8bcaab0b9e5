"""Parallel reads of a database table by bounds. Needs a reachable database, so only the
predicates are checked here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def bound_predicates(column: str, low: int, high: int, parts: int) -> list[str]:
    """Disjoint WHERE clauses that cover every row; the first and last are open, nulls go first."""
    if parts < 2 or high - low < 2:
        return ["1 = 1"]
    parts = min(parts, high - low)
    cuts = [low + (high - low) * i // parts for i in range(1, parts)]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *middle, f"{column} >= {cuts[-1]}"]


def read_table(
    spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **properties: str
) -> DataFrame:
    """One task per bound range of ``column``; filters and columns are pushed to the database."""
    return spark.read.jdbc(
        url, table, predicates=bound_predicates(column, low, high, parts), properties=properties
    )


def closed_ranges(column: str, low: int, high: int, parts: int) -> list[str]:
    """Disjoint closed ranges that cover low..high; rows outside the bounds are not read."""
    size = high - low + 1
    edges = [low + size * i // parts for i in range(parts + 1)]
    return [f"{column} >= {a} AND {column} <= {b - 1}" for a, b in zip(edges, edges[1:]) if b > a]


def read_query(
    spark: SparkSession, url: str, sql: str, column: str, low: int, high: int, parts: int, **properties: str
) -> DataFrame:
    """A query split by closed bounds on ``column``: one subquery per range."""
    ranges = closed_ranges(column, low, high, parts)
    return spark.read.jdbc(url, f"({sql}) q", predicates=ranges, properties=properties)
