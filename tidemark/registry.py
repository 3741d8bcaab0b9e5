"""Named queries, each with the SQL text that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.tables import Tables

MODULES = (
    "lineage", "sources", "projections", "joins", "aggregates", "windows", "ordering", "sets",
    "maths", "strings", "datetimes", "collections", "texts", "generators", "udfs",
    "streams", "dstreams", "graphs", "features", "models", "statistics", "workloads",
)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        return self.build(Tables(spark, path))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``; ``sql`` is its independent check."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register


def same(name: str, sql: str) -> None:
    """Register a query whose Spark SQL text is standard enough to run unchanged elsewhere."""
    query(name, sql)(lambda t: t.sql(sql))


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"tidemark.plans.{module}")
    return QUERIES


def queries() -> dict[str, Query]:
    return dict(load_all())


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in load_all().items() if q.sql is not None}
