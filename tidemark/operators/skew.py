"""Joins and aggregates that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: at most 1/share of them.

    One partial-aggregated count; null keys never match in a join and are left out.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = df.agg((F.count("*") * F.lit(share)).alias("_limit"))
    return counts.join(F.broadcast(total), F.col("_n") > F.col("_limit")).select(key)


def skew_join(
    left: DataFrame, right: DataFrame, key: str, *, share: float = 0.02, salts: int = 32,
    row: Column | None = None,
) -> DataFrame:
    """Inner join that spreads the left side's hot keys over ``salts`` buckets.

    Only the hot keys' right rows are copied, once per bucket; all other keys get bucket 0. The
    bucket is a hash of the row, so recomputed tasks put rows where they were. For hot keys known
    only at run time AQE's skew join does the same to splits of one shuffle; this also covers the
    aggregate after the join.
    """
    hot = F.broadcast(hot_keys(left, key, share).withColumn("_hot", F.lit(True)))  # <= 1/share rows
    bucket = F.pmod(row if row is not None else F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    salted = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), bucket).otherwise(F.lit(0))
    ).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def broadcast_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if a bounded count shows at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
