"""Hypothesis tests as aggregates."""

from __future__ import annotations

from collections.abc import Callable

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import average_ranks, with_running_totals


def chi_squared_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, degrees) from the contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("ra"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("t"))
    # empty cells count too: sum over cells of n^2 / expected, less the total
    joined = cells.join(rows, a).join(columns, b).crossJoin(F.broadcast(total))  # one row
    part = F.col("n") * F.col("n") * F.col("t") / (F.col("ra") * F.col("cb"))
    return joined.agg(
        (F.sum(part) - F.max("t")).alias("statistic"),
        ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("degrees"))


def chi_squared_fit(df: DataFrame, value: str) -> DataFrame:
    """Goodness of fit to equal shares of the values that occur."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.agg(
        (F.sum(F.col("n") * F.col("n")) * F.count("*") / F.sum("n") - F.sum("n")).alias("statistic"), (F.count("*") - 1).alias("degrees"))


def kolmogorov_smirnov(df: DataFrame, value: str, cdf: Callable[[Column], Column]) -> DataFrame:
    """Largest distance between the sample's and the given distribution function."""
    counts = df.groupBy(value).agg(F.count("*").alias("k"))
    run = with_running_totals(counts, [value], {"upto": "k"})
    n = df.agg(F.count(value).alias("n"))
    f = cdf(F.col(value))
    rows = run.crossJoin(F.broadcast(n))  # one row
    return rows.agg(F.max(F.greatest(
        F.abs(F.col("upto") / F.col("n") - f), F.abs(f - (F.col("upto") - F.col("k")) / F.col("n")))).alias("statistic"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks; ranks are found per distinct value."""
    pairs = df.groupBy(x, y).agg(F.count("*").alias("w"))
    rx = average_ranks(df.select(x), x, "rx")
    ry = average_ranks(df.select(y), y, "ry")
    ranked = pairs.join(rx, x).join(ry, y)
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    s = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    cov = F.col("ab") / F.col("n") - F.col("a") / F.col("n") * F.col("b") / F.col("n")
    va = F.col("aa") / F.col("n") - F.pow(F.col("a") / F.col("n"), 2)
    vb = F.col("bb") / F.col("n") - F.pow(F.col("b") / F.col("n"), 2)
    return s.select((cov / F.sqrt(va * vb)).alias("rho"))


def welch(df: DataFrame, keys: list, group: Column, value: str) -> DataFrame:
    """t statistic and degrees of freedom of group true against group false, per key."""
    def side(flag):
        x = F.when(group == flag, F.col(value))
        return F.count(x), F.avg(x), F.var_samp(x)

    (n1, m1, v1), (n0, m0, v0) = side(F.lit(True)), side(F.lit(False))
    s = df.groupBy(*keys).agg(n1.alias("n1"), m1.alias("m1"), v1.alias("v1"), n0.alias("n0"), m0.alias("m0"), v0.alias("v0"))
    return t_statistic(s)


def t_statistic(s: DataFrame) -> DataFrame:
    """Adds Welch's and Student's statistic to rows with n, mean m and variance v of two groups."""
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    spread = F.col("m1") - F.col("m0")
    degrees = F.pow(e1 + e0, 2) / (e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    return s.withColumns({
        "welch_t": spread / F.sqrt(e1 + e0), "welch_df": degrees,
        "student_t": spread / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0")))})


def kernel_density(df: DataFrame, value: str, points: list[float], width: float) -> DataFrame:
    """Gaussian kernel density at a few points: one pass, one aggregate per point."""
    scale = 1 / (width * math.sqrt(2 * math.pi))
    sums = df.agg(*[
        (F.avg(F.exp(-F.pow((F.col(value) - p) / width, 2) / 2)) * scale).alias(f"d{i}") for i, p in enumerate(points)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("point"), F.col(f"d{i}").alias("density")) for i, p in enumerate(points)]))
    return sums.select(rows.alias("r")).select("r.*")
