"""Random columns as functions of a key and a seed: the same on every run of a task."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 1 << 52


def uniform(seed: int, *key: str) -> Column:
    """In (0, 1), open at both ends."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(_STEPS)) + 0.5) / F.lit(float(_STEPS))


def normal(seed: int, *key: str) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(seed, *key)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed + 1, *key))


def exponential(mean: float, seed: int, *key: str) -> Column:
    return F.lit(-mean) * F.ln(uniform(seed, *key))


def log_normal(mean: float, std: float, seed: int, *key: str) -> Column:
    return F.exp(F.lit(mean) + F.lit(std) * normal(seed, *key))


def gamma(shape: int, scale: float, seed: int, *key: str) -> Column:
    """Integer shape: a sum of exponentials."""
    total = F.lit(0.0)
    for i in range(shape):
        total = total + exponential(scale, seed + i, *key)
    return total


def poisson(mean: float, seed: int, *key: str) -> Column:
    """Inverse of the distribution function; the tail beyond the last term is below 1e-16."""
    u, term, below = uniform(seed, *key), math.exp(-mean), 0.0
    steps = []
    k = 0
    while below < 1 - 1e-16 and k < 40 + 10 * mean:
        below += term
        steps.append(F.when(u >= below, 1).otherwise(0))
        k += 1
        term *= mean / k
    total = F.lit(0)
    for s in steps:
        total = total + s
    return total
