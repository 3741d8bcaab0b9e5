"""Samples that do not change when a task is run again.

A row is drawn by a hash of its key, so the sample depends on the data and the seed only, and not
on partitions or row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import row_numbers, with_index

_STEPS = 1 << 30


def unit_hash(key: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) from the key columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(_STEPS)) / F.lit(_STEPS)


def bernoulli(df: DataFrame, key: Sequence[str], fraction: float, seed: int) -> DataFrame:
    return df.where(unit_hash(key, seed) < fraction)


def stratified(
    df: DataFrame, key: Sequence[str], stratum: str, fractions: Mapping, seed: int
) -> DataFrame:
    """Each row of a stratum with its own probability; unlisted strata give none."""
    share = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(f)) for s, f in fractions.items()], F.lit(0.0))
    return df.where(unit_hash(key, seed) < share)


def stratified_exact(
    df: DataFrame, key: Sequence[str], stratum: str, fraction: float, seed: int
) -> DataFrame:
    """Exactly ceil(fraction * size) rows of each stratum, in hash order."""
    drawn = df.withColumn("_u", F.xxhash64(F.lit(seed), *key))
    numbered = row_numbers(drawn, [stratum], ["_u", *key], "_n")
    sizes = df.groupBy(stratum).agg(F.ceil(F.count("*") * F.lit(fraction)).alias("_keep"))
    return numbered.join(sizes, stratum).where("_n <= _keep").drop("_u", "_n", "_keep")


def fixed_size(df: DataFrame, key: Sequence[str], k: int, seed: int) -> DataFrame:
    """k rows without replacement: the k smallest hashes (partial top-k in each task)."""
    drawn = df.withColumn("_u", F.xxhash64(F.lit(seed), *key))
    return drawn.orderBy("_u", *key).limit(k).drop("_u")


def split(df: DataFrame, key: Sequence[str], weights: Sequence[float], seed: int) -> list[DataFrame]:
    """Disjoint parts that cover all rows."""
    total = sum(weights)
    edges, parts = 0.0, []
    u = unit_hash(key, seed)
    for i, w in enumerate(weights):
        low, edges = edges, edges + w / total
        upper = F.lit(True) if i == len(weights) - 1 else u < edges
        parts.append(df.where((u >= low) & upper))
    return parts


def every_nth(df: DataFrame, order: Sequence[str], step: int) -> DataFrame:
    """Systematic sample over the whole ordered table."""
    return with_index(df, order, "_i").where(F.col("_i") % step == 0).drop("_i")
