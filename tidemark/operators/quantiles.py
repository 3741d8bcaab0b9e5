"""Quantile summaries that tasks build, a tree merges, and nobody collects; and exact ranks by a range sort.

A summary is a list of (value, least, most): a value of the column and bounds of its rank among all
values. A task sorts its values in blocks and keeps every so many of them; two summaries are merged
by adding up, for each value, its own bounds and those that its neighbours have in the other one.
Merging keeps the relative error, pruning adds a known share, so the error of the whole is bounded
by that of the leaves and one share per level of the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_running_totals
from tidemark.session import stored

FAN_IN = 16
BLOCK = 1 << 18  # values that a task sorts at once
LEVELS = 8  # pruned levels that an error is planned for: FAN_IN ** LEVELS tasks

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def summary_of(values: np.ndarray) -> Summary:
    """The exact summary: every value with its rank, counted from 1."""
    values = np.sort(values)
    ranks = np.arange(1, len(values) + 1, dtype=np.int64)
    return values, ranks, ranks.copy(), len(values)


def pruned(summary: Summary, share: float) -> Summary:
    """About 1 / share entries: the ends, and for each step of the ranks the entry next to it. Adds share / 2 to the error."""
    values, least, most, n = summary
    size = max(2, int(np.ceil(1 / share)) + 1)
    if len(values) <= size:
        return summary
    wanted = np.linspace(1, n, size)
    middle = (least + most) / 2
    at = np.clip(np.searchsorted(middle, wanted), 1, len(values) - 1)
    at -= (wanted - middle[at - 1] < middle[at] - wanted).astype(np.int64)
    at = np.unique(np.concatenate([[0], at, [len(values) - 1]]))
    return values[at], least[at], most[at], n


def merged(one: Summary, two: Summary) -> Summary:
    """Both summaries as one; its error is at most the larger of theirs."""
    if not one[3] or not two[3]:
        return one if one[3] else two

    def placed(own: Summary, other: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
        # of equal values those of the first summary come first
        at = np.searchsorted(other[0], own[0], side=side)
        below = np.where(at > 0, other[1][np.maximum(at - 1, 0)], 0)
        above = np.where(at < len(other[0]), other[2][np.minimum(at, len(other[0]) - 1)] - 1, other[3])
        return own[1] + below, own[2] + above

    least_one, most_one = placed(one, two, "left")
    least_two, most_two = placed(two, one, "right")
    values = np.concatenate([one[0], two[0]])
    order = np.argsort(values, kind="stable")
    least, most = np.concatenate([least_one, least_two])[order], np.concatenate([most_one, most_two])[order]
    return values[order], least, most, one[3] + two[3]


def _rows(node: int, summary: Summary) -> pa.RecordBatch:
    values, least, most, n = summary
    k = len(values)
    return pa.RecordBatch.from_arrays(
        [pa.array([node] * k, pa.int64()), pa.array(values, pa.float64()), pa.array(least, pa.int64()), pa.array(most, pa.int64()), pa.array([n] * k, pa.int64())],
        ["node", "value", "least", "most", "n"])


_SCHEMA = "node bigint, value double, least bigint, most bigint, n bigint"


def summarised(df: DataFrame, column: str, error: float) -> DataFrame:
    """(value, least, most, n) of the non-null values of ``column``: a summary whose ranks are off by ``error`` * n at most.

    One pass over the table; each task sends 1 / share rows, and levels of FAN_IN tasks merge them
    until one is left. NaN counts as the largest value, -0.0 as 0.0.
    """
    if not 0 < error < 1:
        raise ValueError("error must be in (0, 1)")
    share = error / (LEVELS + 1)

    def build(batches):
        held, size, whole = [], 0, (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), 0)

        def add(whole: Summary) -> Summary:
            return pruned(merged(whole, summary_of(np.concatenate(held))), share / 64) if held else whole

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False) + 0.0)
            size += batch.num_rows
            if size >= BLOCK:
                whole, held, size = add(whole), [], 0
        whole = add(whole)
        if whole[3]:
            yield _rows(TaskContext.get().partitionId(), pruned(whole, share))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, part in rows.groupby("node", sort=True):
            part = part.sort_values(["least", "most"])
            own = part["value"].to_numpy(), part["least"].to_numpy(), part["most"].to_numpy(), int(part["n"].iloc[0])
            whole = own if whole is None else merged(whole, own)
        values, least, most, n = pruned(whole, share)
        return pd.DataFrame({"node": key[0], "value": values, "least": least, "most": most, "n": n})

    values = df.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL")
    nodes = stored(values.mapInArrow(build, _SCHEMA), "summaries")
    while nodes.select("node").distinct().limit(2).count() > 1:
        parent = (F.col("node") / FAN_IN).cast("bigint")
        nodes = stored(nodes.withColumn("parent", parent).groupBy("parent").applyInPandas(
            lambda key, rows: merge(key, rows.drop(columns="parent")), _SCHEMA), "summaries")
    return nodes.drop("node")


def quantiles_of(summary: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, value) from a summary: the entry whose bounds lie nearest around the rank ceil(share * n). No rows without values."""
    wanted = summary.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n")))
    off = F.greatest(rank - F.col("least"), F.col("most") - rank)
    return wanted.groupBy("share").agg(F.min(F.struct(off.alias("off"), "value")).alias("best")).select("share", "best.value")


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by.., share, value): the value of rank ceil(share * n), at least 1, per group; error 0.

    Values are counted first, then summed up over a range sort of (group, value): equal values are
    one row, and neither a group nor the column meets in one task. Nulls are left out.
    """
    keys = list(by)
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("times"))
    running = stored(with_running_totals(counts, [*keys, "value"], {"upto": "times"}), "ranks")
    # ranks start anew with each group: what lies before its first value is taken off
    groups = running.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min(F.col("upto") - F.col("times")).alias("before"), F.sum("times").alias("n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = running.join(groups if keys else F.broadcast(groups), same)  # without keys one row
    wanted = placed.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n")))
    upto = F.col("upto") - F.col("before")
    return wanted.where((upto >= rank) & (upto - F.col("times") < rank)).select(*keys, "share", "value")
