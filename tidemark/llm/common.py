"""What several operators share: columns of texts as bytes, split folds, word tables, rank directories."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# bytes of words of the letter-and-digit kind: a-z, 0-9 and everything outside ASCII; A-Z become a-z, the rest blank
PLAIN_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
# only A-Z become a-z; bytes.split() then cuts at blank and \t \n \v \f \r
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fold(doc_id: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string or binary column as bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def flat_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one array of bytes and the n + 1 borders of its values; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    borders = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), borders - borders[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[borders[0]:borders[-1]]
    return data, borders - borders[0]


def pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to ``limit`` at most; a larger row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def column_like(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def release() -> None:
    """Gives freed memory back to the system; a Python worker lives on behind its task and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def packed(docs: DataFrame) -> DataFrame:
    """``text`` compressed, as ``z``, for exchanges in which whole texts meet what was found in them."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([squeeze.compress(t) for t in binary_column(batch, "text")], pa.binary())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, pa.field("z", pa.binary()), z)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.select(*[c for c in docs.columns if c != "text"], "text").mapInArrow(run, f"{kinds}, z binary")


class Bits:
    """A bitmap with a rank directory: the ones before each 64-bit word are stored, the rest is one popcount."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        packed = np.packbits(flags, bitorder="little")
        words = np.zeros(len(flags) // 64 + 1, "<u8")
        words.view(np.uint8)[:len(packed)] = packed
        ones = np.bitwise_count(words).astype("<u4")
        return cls(words, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex that has an edge (a, b): the smallest id that links reach.

    Large-star and small-star steps by turns until each vertex is linked to the least one of its
    component alone. Each round is written to the shared folder, so lost executors cost one round.
    """
    from tidemark.session import stored

    def descending(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def unfinished(links: DataFrame) -> DataFrame:
        ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(links.select("v", F.lit(0)))
        return ends.groupBy("id").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 AND n > 1")

    links = stored(descending(edges.toDF("u", "v")), "links")
    while not unfinished(links).isEmpty():
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = descending(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = stored(descending(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)), "links")
    members = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(members.select("component", "component")).distinct()
