"""Positions and running totals over a whole table, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import checkpointed, shuffle_partitions

_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _offsets(per_partition: DataFrame, totals: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums over partitions; one row per partition, so a plain window is fine."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_partition.select(
        "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in totals]
    )


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partitioned, sorted and pinned, so partition numbers can be read twice."""
    parts = shuffle_partitions(df.sparkSession)
    return checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))


def with_index(df: DataFrame, order: Sequence[Column | str], name: str = "index") -> DataFrame:
    """Zero-based position of each row in the global order (``order`` should be unique).

    A range shuffle over all order columns splits hot leading values by the later columns; the
    position is the row number in the partition plus the rows of earlier partitions.
    """
    return indexed_partitions(ranged(df, order), name)


def indexed_partitions(pinned: DataFrame, name: str = "index") -> DataFrame:
    """Number the rows of a pinned DataFrame in its partition order."""
    numbered = pinned.withColumn("_mid", F.monotonically_increasing_id()).withColumns({
        "_part": F.shiftright("_mid", _BITS),
        "_row": F.col("_mid").bitwiseAND(F.lit((1 << _BITS) - 1)),
    })
    counts = numbered.groupBy("_part").agg((F.max("_row") + 1).alias("n"))
    offsets = _offsets(counts, ["n"])
    return (
        numbered.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_row") + F.col("_before_n"))
        .drop("_mid", "_part", "_row", "_before_n")
    )


def with_running_totals(
    df: DataFrame, order: Sequence[Column | str], totals: dict[str, str]
) -> DataFrame:
    """Add inclusive running sums ``{new column: summed column}`` in the global order.

    Sums run over Arrow batches inside each sorted partition; partition totals, one row each,
    shift them. No shuffle beyond the range sort.
    """
    pinned = ranged(df, order).withColumn("_part", F.spark_partition_id())
    doubles = {n: F.col(c).cast("double").alias(n) for n, c in totals.items()}
    names = list(totals)
    staged = pinned.select("*", *doubles.values())
    schema = staged.schema

    def run(batches):
        carry = dict.fromkeys(names, 0.0)
        for batch in batches:
            for n in names:
                i = batch.schema.get_field_index(n)
                sums = pc.add(pc.cumulative_sum(batch.column(i)), carry[n])
                if len(sums):
                    carry[n] = sums[len(sums) - 1].as_py()
                batch = batch.set_column(i, pa.field(n, pa.float64()), sums)
            yield batch

    local = staged.mapInArrow(run, schema)
    offsets = _offsets(
        staged.groupBy("_part").agg(*[F.sum(n).alias(n) for n in names]), names
    )
    shifted = local.join(F.broadcast(offsets), "_part")  # one row per partition
    return shifted.withColumns(
        {n: F.col(n) + F.col(f"_before_{n}") for n in names}
    ).drop("_part", *[f"_before_{n}" for n in names])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str
) -> DataFrame:
    """``row_number`` per key for keys that may hold any share of the table.

    Rows are range-partitioned by key and order, so a hot key spans many tasks; the number is the
    global position less that of the key's first row. ``order`` should be unique within a key.
    """
    placed = with_index(df, [*keys, *order], "_at")
    first = placed.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(
        F.min("_at").alias("_first")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    joined = placed.join(first, same)
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name))


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Distinct values with their average rank (ties share the mean of their positions)."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    run = with_running_totals(counts, [value], {"_upto": "_n"})
    return run.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))


def number_copies(df: DataFrame, name: str = "copy", chunk: int = 1_000_000) -> DataFrame:
    """Number equal rows 0, 1, 2, ... so that each row becomes unique.

    Copies are counted first (map-side partial sums), then written out again in chunks that are
    spread over tasks, so a row copied billions of times does not land in one task.
    """
    columns = df.columns
    counts = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    chunks = counts.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {chunk}"))))
    spread = chunks.repartition(shuffle_partitions(df.sparkSession), *columns, "_chunk")
    first = F.col("_chunk") * chunk
    return spread.withColumn(
        name, F.explode(F.sequence(first, F.least(F.col("_n"), first + chunk) - 1))
    ).select(*columns, F.col(name).cast(T.LongType()).alias(name))
