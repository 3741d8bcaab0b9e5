"""Window functions for keys that may hold any share of the table.

A plain window puts a key's rows into one task. Here rows are numbered inside their key over a
range shuffle, and windows then run over blocks of consecutive numbers: bounded frames get the
few neighbouring rows they need copied into their block, unbounded ones get the totals of the
earlier blocks, of which there is one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.operators.ordering import row_numbers
from tidemark.session import stored

BLOCK = 100_000


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """Rows with their number in the key, stored so that several windows can share it."""
    return stored(row_numbers(df, keys, order, name), "numbered")


def _block(rn: Column, size: int) -> Column:
    return F.floor((rn - 1) / size).cast("bigint")


def framed(
    rows: DataFrame, keys: Sequence[str], preceding: int, following: int,
    columns: Mapping[str, Callable[[WindowSpec], Column]], rn: str = "rn", block: int = BLOCK,
) -> DataFrame:
    """Any window columns over ROWS BETWEEN ``preceding`` PRECEDING AND ``following`` FOLLOWING.

    Also lag and lead by at most that many rows. A row is copied into a neighbour block only if it
    lies within the frame's reach of the border.
    """
    n = F.col(rn)
    reach = F.sequence(_block(F.greatest(n - following, F.lit(1)), block), _block(n + preceding, block))
    copied = rows.withColumn("_b", F.explode(reach))
    window = Window.partitionBy(*keys, "_b").orderBy(rn)
    done = copied.withColumns({c: make(window) for c, make in columns.items()})
    return done.where(F.col("_b") == _block(n, block)).drop("_b")


def running(
    rows: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[Callable[[str], Column], str]],
    rn: str = "rn", block: int = BLOCK,
) -> DataFrame:
    """Aggregates from the key's first row to the current one: sum, count, min or max.

    ``columns`` maps a new name to (aggregate, column). The carry is the same aggregate over the
    block totals before this block (sums add up, counts too).
    """
    in_block = Window.partitionBy(*keys, "_b").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.withColumn("_b", _block(F.col(rn), block))
    totals = cut.groupBy(*keys, "_b").agg(*[agg(c).alias(f"_t_{n}") for n, (agg, c) in columns.items()])

    def carry(name, agg):
        merge = F.sum if agg in (F.sum, F.count) else agg
        return merge(f"_t_{name}").over(before).alias(f"_c_{name}")

    carried = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_bb"), *[carry(n, a) for n, (a, _) in columns.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = cut.withColumns({f"_l_{n}": a(c).over(in_block) for n, (a, c) in columns.items()}).join(
        carried, [*same, F.col("_b") == F.col("_bb")])

    def merged(name, agg):
        here, earlier = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if agg in (F.sum, F.count):
            both = F.coalesce(earlier + here, here, earlier)
        elif agg is F.min:
            both = F.least(earlier, here)
        else:
            both = F.greatest(earlier, here)
        return both.alias(name)

    return joined.select(*rows.columns, *[merged(n, a) for n, (a, _) in columns.items()])


def _by_key(rows: DataFrame, keys: Sequence[str], *aggregates: Column, extra: Sequence[str] = ()) -> DataFrame:
    """Join per-key values back; the key side has one row per key, so a hot key's rows are split."""
    on = [*keys, *extra]
    values = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]).agg(*aggregates)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(on)]
    return rows.join(values, same).drop(*[f"_k{i}" for i in range(len(on))])


def ranks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], rn: str = "rn", tiles: int = 4) -> DataFrame:
    """rank, dense_rank, percent_rank, cume_dist and ntile from the row numbers.

    ``order`` are the columns whose ties share a rank; rows must be numbered by them first.
    """
    sized = _by_key(rows, keys, F.count("*").alias("_n"))
    tied = _by_key(sized, keys, F.min(rn).alias("rank"), F.max(rn).alias("_last"), extra=order)
    distinct = rows.select(*keys, *order).distinct()
    dense = row_numbers(distinct, keys, order, "dense_rank").withColumnsRenamed(
        {c: f"_d{i}" for i, c in enumerate([*keys, *order])})
    same = [F.col(c).eqNullSafe(F.col(f"_d{i}")) for i, c in enumerate([*keys, *order])]
    joined = tied.join(dense, same)
    n, r = F.col("_n"), F.col(rn)
    small, large = F.floor(n / tiles), n % tiles
    border = large * (small + 1)
    tile = F.when(r <= border, F.floor((r - 1) / (small + 1)) + 1).otherwise(large + F.floor((r - border - 1) / F.greatest(small, F.lit(1))) + 1)
    return joined.select(
        *rows.columns, "rank", "dense_rank", F.when(n > 1, (F.col("rank") - 1) / (n - 1)).otherwise(0.0).alias("percent_rank"),
        (F.col("_last") / n).alias("cume_dist"), tile.cast("bigint").alias("ntile"))


def over_key(rows: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates over all rows of a key beside each row."""
    return _by_key(rows, keys, *aggregates)


def rank(rows: DataFrame, keys: Sequence[str], order: Sequence[str], rn: str = "rn", name: str = "rank") -> DataFrame:
    """The rank alone, in place of the row number; ``order`` may be ascending or not, as the rows were numbered."""
    return _by_key(rows, keys, F.min(rn).alias(name), extra=order).drop(rn)


def ends(rows: DataFrame, keys: Sequence[str], value: str, rn: str = "rn") -> DataFrame:
    """first_value and last_value over the whole key."""
    return _by_key(rows, keys, F.min_by(value, rn).alias("first_value"), F.max_by(value, rn).alias("last_value"))
