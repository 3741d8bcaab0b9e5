"""Bloom filter and count-min sketch as small tables that merge by aggregation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BloomFilter:
    """Words of 64 bits; the number of bits is a power of two fixed at creation."""

    words: DataFrame  # word bigint, bits bigint
    bits: int
    hashes: int

    @staticmethod
    def sizes(items: int, fpp: float) -> tuple[int, int]:
        need = -items * math.log(fpp) / math.log(2) ** 2
        bits = max(64, 1 << math.ceil(math.log2(need)))
        return bits, max(1, round(bits / items * math.log(2)))

    @classmethod
    def build(cls, df: DataFrame, key: str, items: int, fpp: float) -> BloomFilter:
        bits, hashes = cls.sizes(items, fpp)
        places = df.select(F.explode(F.array(*_places(F.col(key), bits, hashes))).alias("p"))
        return cls(places.groupBy(F.shiftright("p", 6).alias("word")).agg(_or_bits().alias("bits")), bits, hashes)

    def merge(self, other: BloomFilter) -> BloomFilter:
        if (self.bits, self.hashes) != (other.bits, other.hashes):
            raise ValueError("filters of different size cannot be merged")
        both = self.words.union(other.words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        return BloomFilter(both, self.bits, self.hashes)

    def test(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """Add a column: may ``key`` be in the set? Never false for a member; a null key is a key.

        Each distinct key's bit places meet their words in an equi-join, so no task and no broadcast
        holds the filter.
        """
        keys = df.select(F.col(key).alias("_key")).distinct()
        probes = keys.select("_key", F.explode(F.array(*_places(F.col("_key"), self.bits, self.hashes))).alias("p"))
        found = probes.withColumn("word", F.shiftright("p", 6)).join(self.words, "word", "left")
        bit = F.expr("coalesce(bits, 0L) >> int(p & 63)").bitwiseAND(F.lit(1)) == 1
        tested = found.groupBy("_key").agg(F.bool_and(bit).alias(name))
        return df.join(tested, df[key].eqNullSafe(F.col("_key")), "left").drop("_key")


def _places(key: Column, bits: int, hashes: int) -> list[Column]:
    return [F.xxhash64(F.lit(i), key).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]


def _or_bits() -> Column:
    return F.bit_or(F.expr("shiftleft(1L, int(p & 63))"))


@dataclass(frozen=True)
class CountMin:
    """depth x width counters; an estimate is never below the true count."""

    counters: DataFrame  # row int, col bigint, n bigint
    width: int
    depth: int

    @classmethod
    def build(cls, df: DataFrame, key: str, eps: float, confidence: float) -> CountMin:
        width, depth = math.ceil(2 / eps), math.ceil(-math.log(1 - confidence) / math.log(2))
        # count equal keys first, then spread depth rows per distinct key and partition
        counts = df.groupBy(key).agg(F.count("*").alias("n"))
        cells = counts.select(_cells(F.col(key), width, depth), "n")
        return cls(cells.groupBy("c.row", "c.col").agg(F.sum("n").alias("n")), width, depth)

    def merge(self, other: CountMin) -> CountMin:
        both = self.counters.union(other.counters).groupBy("row", "col").agg(F.sum("n").alias("n"))
        return CountMin(both, self.width, self.depth)

    def estimate(self, keys: DataFrame, key: str) -> DataFrame:
        cells = keys.select(key, _cells(F.col(key), self.width, self.depth)).select(key, "c.row", "c.col")
        return cells.join(self.counters, ["row", "col"], "left").groupBy(key).agg(
            F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def _cells(key: Column, width: int, depth: int) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(width)).alias("col"))
        for i in range(depth)
    ])).alias("c")
