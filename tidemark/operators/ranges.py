"""Joins on ranges, with an equi-join on range bins in place of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_in_range(
    points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: float
) -> DataFrame:
    """Pairs with low <= point < high.

    Each range is listed under every bin of ``width`` it touches and each point under its own bin,
    so rows meet by an equi-join and every pair is found exactly once. Choose ``width`` near the
    usual range length: a range is copied about length/width + 1 times.
    """
    def bin_of(c: Column) -> Column:
        return F.floor(c / F.lit(width)).cast("bigint")

    listed = ranges.withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return points.withColumn("_bin", bin_of(point)).join(listed, "_bin").where(
        (point >= low) & (point < high)
    ).drop("_bin")
