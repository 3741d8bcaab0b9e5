"""Python functions on groups of any size: a large group is cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAX_ROWS = 100_000


def with_pieces(df: DataFrame, key: str, row: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """Add ``piece``: 0 for groups of at most ``max_rows`` rows, else a hash of the row.

    Only the sizes of groups above the limit are joined back: at most rows / max_rows of them.
    """
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows)
    large = sizes.select("_key", F.ceil(F.col("_n") / max_rows).alias("_pieces"))
    joined = df.join(large, F.col(key).eqNullSafe(F.col("_key")), "left")
    piece = F.when(F.col("_pieces").isNotNull(), F.pmod(row, F.col("_pieces"))).otherwise(F.lit(0))
    return joined.withColumn("piece", piece).drop("_key", "_pieces")


def map_groups(
    df: DataFrame, key: str, row: Column, partial: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
    *merge: Column, max_rows: int = MAX_ROWS, many: bool = False,
) -> DataFrame:
    """Apply ``partial`` to every piece of a group and merge its rows by aggregates.

    ``partial`` gets a frame of one key and returns rows with the key and its partial values. With
    ``many`` it gets frames of many whole pieces instead and returns rows for each key: where most
    groups are small, a call per group costs far more than its rows.
    """
    pieces = with_pieces(df, key, row, max_rows)

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return partial(rows.drop(columns="piece"))

    if many:
        dealt = pieces.repartition(key, "piece").sortWithinPartitions(key, "piece")
        done = dealt.mapInArrow(_of_whole_pieces(key, partial, to_arrow_schema(StructType.fromDDL(schema))), schema)
    else:
        done = pieces.groupBy(key, "piece").applyInPandas(run, schema)
    return done.groupBy(key).agg(*merge)


def _of_whole_pieces(key: str, partial: Callable[[pd.DataFrame], pd.DataFrame], schema: pa.Schema):
    """A task's rows come sorted by piece; the last piece of a batch waits for the batches behind it."""

    def call(rows: pa.Table):
        # rows without a key go apart, so that the other keys keep their type
        for own in (rows.filter(pc.is_null(rows[key])), rows.filter(pc.is_valid(rows[key]))):
            if own.num_rows:
                yield from pa.Table.from_pandas(partial(own.drop(["piece"]).to_pandas()), schema, preserve_index=False).to_batches()

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            last = [rows[c][len(rows) - 1].as_py() for c in (key, "piece")]
            starts = _first_of(rows, key, last)
            if starts is not None:  # all pieces before the last one are whole
                yield from call(pa.concat_tables([*held, rows.slice(0, starts)]))
                held = []
            held.append(rows.slice(starts or 0))
        if held:
            yield from call(pa.concat_tables(held))

    return run


def _first_of(rows: pa.Table, key: str, last: list) -> int | None:
    """Where the last piece of ``rows`` begins; None if all rows are of that piece, which may have begun before."""
    same_key = pc.is_null(rows[key]) if last[0] is None else pc.fill_null(pc.equal(rows[key], pa.scalar(last[0], rows[key].type)), False)
    other = pc.invert(pc.and_(same_key, pc.equal(rows["piece"], last[1])))
    n = pc.sum(other).as_py()
    return n or None
