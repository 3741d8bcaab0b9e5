"""A PySpark-native analytics library with record-level lineage."""

from tidemark.registry import QUERIES, oracle_sql, queries
from tidemark.tables import Tables

__all__ = ["QUERIES", "Tables", "oracle_sql", "queries"]
