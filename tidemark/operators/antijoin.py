"""NOT IN with SQL's treatment of nulls, as a shuffled anti join instead of a broadcast of the subquery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows of ``df`` with ``column NOT IN (SELECT value FROM values)``, whatever the size of ``values``.

    An empty ``values`` keeps all rows; one with a null keeps none; else rows of a null ``column`` and
    those whose value occurs go. Two facts about ``values``, one row, decide about the nulls; the rest
    is an anti join on equal values that Spark plans by size.
    """
    facts = values.agg(F.count("*").alias("_n"), F.count(value).alias("_known"))  # one row
    known = values.where(F.col(value).isNotNull()).select(F.col(value).alias("_value")).distinct()
    absent = df.join(known, df[column] == F.col("_value"), "left_anti")
    kept = absent.crossJoin(F.broadcast(facts))
    return kept.where((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(column).isNotNull())).select(*df.columns)
