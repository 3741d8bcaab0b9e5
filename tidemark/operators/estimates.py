"""Estimates from a sample, with a confidence interval."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sampling import bernoulli


def estimate(
    df: DataFrame, key: Sequence[str], value: str, fraction: float, confidence: float = 0.95, seed: int = 1
) -> DataFrame:
    """Count, sum and mean from a hash sample, each with a normal bound."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    s = bernoulli(df.select(*key, value), key, fraction, seed).agg(
        F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"),
        F.stddev(value).alias("dev"))
    rest = 1 - fraction
    rows = F.explode(F.array(
        F.struct(F.lit("count").alias("what"), (F.col("n") / fraction).alias("mean"),
                 (z * F.sqrt(F.col("n") * rest) / fraction).alias("bound")),
        F.struct(F.lit("sum").alias("what"), (F.col("s") / fraction).alias("mean"),
                 (z * F.sqrt(F.col("q") * rest) / fraction).alias("bound")),
        F.struct(F.lit("mean").alias("what"), (F.col("s") / F.col("n")).alias("mean"),
                 (z * F.col("dev") / F.sqrt("n")).alias("bound")),
    ))
    return s.select(rows.alias("e")).select(
        "e.what", F.col("e.mean").alias("estimate"), (F.col("e.mean") - F.col("e.bound")).alias("low"),
        (F.col("e.mean") + F.col("e.bound")).alias("high"))
