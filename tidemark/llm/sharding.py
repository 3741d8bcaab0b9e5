"""A uniform shuffle into shards of exact sizes.

How many rows each partition sends to each shard is drawn first, as a matrix with the partitions'
row counts as row sums and the shard sizes as column sums (multivariate hypergeometric, which is
what a uniform permutation of all rows would give). Each partition then labels its rows in a
random order by its row of the matrix, the rows are exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import with_index
from tidemark.session import checkpointed

EXACT_LIMIT = 10**9  # beyond it numpy draws no hypergeometric numbers


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, limit: int = EXACT_LIMIT) -> int:
    """How many of ``n`` rows drawn out of good + bad are good.

    Beyond ``limit`` by inversion over a window of 40 standard deviations around the mode; the
    ratios of neighbouring probabilities are exact, so nothing but rounding is lost.
    """
    total = good + bad
    if total < limit:
        return int(rng.hypergeometric(good, bad, n)) if total else 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5
    first, last = max(low, mode - int(40 * sd) - 40), min(high, mode + int(40 * sd) + 40)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    return first + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right"))


def communication_matrix(rows: list[int], sizes: list[int], seed: int, limit: int = EXACT_LIMIT) -> np.ndarray:
    """Rows that go from partition i to shard j, uniform among all permutations."""
    if sum(rows) != sum(sizes):
        raise ValueError("partitions and shards hold different numbers of rows")
    rng = np.random.default_rng(seed)
    free, matrix = list(sizes), np.zeros((len(rows), len(sizes)), np.int64)
    for i, n in enumerate(rows):
        rest = sum(free)
        for j in range(len(free)):
            rest -= free[j]
            matrix[i, j] = hypergeometric(rng, free[j], rest, n, limit)
            n -= int(matrix[i, j])
            free[j] -= int(matrix[i, j])
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Adds ``shard`` and ``slot``: a uniform random permutation cut into shards whose sizes differ by one at most.

    ``df`` is pinned by a reliable checkpoint, so pass narrow rows (ids and sizes): counts and
    labels then see the same partitions, and a lost task gives the same labels again. The driver
    holds one number per partition and shard. The second permutation is a range sort by (shard,
    random number) whose positions give the slots, so no shard sits in one task. An empty table
    gives no rows; repeated rows and nulls are rows like any other. ``shard`` and ``slot`` must not
    be columns of ``df``.
    """
    pinned = checkpointed(df)
    counted = pinned.groupBy(F.spark_partition_id().alias("part")).count().collect()
    parts = pinned.rdd.getNumPartitions()
    rows = [0] * parts
    for r in counted:
        rows[r["part"]] = r["count"]
    sizes = even_sizes(sum(rows), shards)
    matrix = communication_matrix(rows, sizes, seed)
    schema = T.StructType([*pinned.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("_order", T.LongType())])

    def label(batches):
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, 1, part])
        left = matrix[part].copy()
        for batch in batches:
            n = batch.num_rows
            drawn = np.zeros(len(left), np.int64)
            rest, wanted = int(left.sum()), n
            for j in range(len(left)):
                rest -= int(left[j])
                drawn[j] = hypergeometric(rng, int(left[j]), rest, wanted)
                wanted -= int(drawn[j])
            left -= drawn
            labels = rng.permutation(np.repeat(np.arange(len(left), dtype=np.int32), drawn))
            order = rng.integers(0, 2**63, n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels), pa.array(order)], [*batch.schema.names, "shard", "_order"])

    placed = with_index(pinned.mapInArrow(label, schema), ["shard", "_order", *df.columns[:1]], "_at")
    first = F.array(*[F.lit(int(x)) for x in np.concatenate([[0], np.cumsum(sizes)[:-1]])])
    return placed.withColumn("slot", F.col("_at") - F.element_at(first, F.col("shard") + 1)).drop("_at", "_order")


def document_shards(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """doc_id, size (bytes of the text and 8 more), text_crc32, law, shard, slot, grown_shard of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_to_shards(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
