"""Per-key state kept over micro-batches.

Keys share a state by buckets: a call of the Python function costs far more than a key's rows, so it
handles all keys of a bucket at once. A bucket's state is a small table with a row per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 1024
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata(None)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(state: GroupState) -> list[pd.DataFrame]:
    """The bucket's rows, none if nothing was seen."""
    return [pa.ipc.open_stream(bytes(state.get[0])).read_pandas()] if state.exists else []


def running_totals(stream: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Emit (keys, n, total) for every key of a batch, with all that was seen before.

    Sums do not depend on the order of rows or of the chunks a group arrives in. Add a salt to
    ``keys`` where one key may hold a large share of the stream, and sum over it when reading.
    """
    def update(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [c.groupby("key", sort=False)["v"].agg(n="size", total="sum").reset_index() for c in chunks]
        rows = pd.concat([*_unpacked(state), *new]).groupby("key", as_index=False, sort=False).sum()
        state.update((_packed(rows),))
        yield rows[rows["key"].isin(set().union(*[x["key"] for x in new]))]

    named = ", ".join(f"`{k}` {dict(stream.dtypes)[k]}" for k in keys)
    key = F.to_json(F.struct(*keys), EXACT).alias("key")
    rows = stream.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), key, F.col(value).cast("double").alias("v"))
    done = rows.groupBy("bucket").applyInPandasWithState(
        update, "key string, n bigint, total double", "rows binary", "append", GroupStateTimeout.NoTimeout)
    return done.select(F.from_json("key", named, EXACT).alias("key"), "n", "total").select("key.*", "n", "total")


def sessions(stream: DataFrame, key: str, time: str, gap_minutes: int, buckets: int = BUCKETS) -> DataFrame:
    """Emit (key, events, first, last) when a key was silent for the gap; then drop its state.

    Needs a watermark on ``time``; a key is closed by an event-time timeout, that of its bucket being
    the earliest of its keys. A key with rows in a batch goes on, as does one that isn't due.
    """
    gap_ms = gap_minutes * 60_000

    def update(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        old = _unpacked(state)
        new = [] if state.hasTimedOut else [
            c.groupby(["none", "k"], sort=False)["ms"].agg(events="size", first_ms="min", last_ms="max").reset_index() for c in chunks]
        rows = pd.concat([*old, *[x.assign(due=0) for x in new]])
        rows = rows.groupby(["none", "k"], as_index=False, sort=False).agg({"events": "sum", "first_ms": "min", "last_ms": "max", "due": "last"})
        seen = rows["due"] == 0  # in this batch
        rows.loc[seen, "due"] = rows.loc[seen, "last_ms"].clip(lower=now) + gap_ms
        over = ~seen & (rows["due"] < now)
        open_ = rows[~over]
        if len(open_):
            state.update((_packed(open_),))
            state.setTimeoutTimestamp(int(open_["due"].min()))
        else:
            state.remove()
        if over.any():
            yield rows.loc[over, ["none", "k", "events", "first_ms", "last_ms"]]

    rows = stream.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).isNull().alias("none"), F.coalesce(key, F.lit(0)).cast("bigint").alias("k"),
        time, F.unix_millis(time).alias("ms"))
    done = rows.groupBy("bucket").applyInPandasWithState(
        update, "none boolean, k bigint, events bigint, first_ms bigint, last_ms bigint", "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(F.when(~F.col("none"), F.col("k")).alias(key), "events", "first_ms", "last_ms")
