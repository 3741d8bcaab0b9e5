"""The best items of every user by a factor model, exactly, without scoring all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.neighbours import first_of_each, picked_in_cells
from tidemark.session import stored

MAX_CELLS = 4096
SALTS = 8  # a cell that many users look into is in so many tasks
USERS_AT_ONCE = 256


def _flat(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.asarray(batch.column(i).flatten(), np.float64).reshape(batch.num_rows, -1)


def best_items(users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(user, item, rating): the ``k`` items of largest product with each user's factors, ties by item.

    ``users`` and ``items`` have (id, features). Items lie in cells, between quantiles of each factor;
    a cell's box bounds the products with its items. No cell matters to a user whose bound is below
    the k-th best product with one real item per cell, so only the others are looked into. The
    boxes are at most ``MAX_CELLS`` rows, however many items there are.
    """
    size = items.select(F.size("features").alias("n")).limit(1).collect()
    empty = users.join(items.limit(0).select(F.col("id").alias("item"), F.lit(0.0).cast("float").alias("rating")), F.lit(True)).select(F.col("id").alias("user"), "item", "rating")
    if not size:
        return empty
    dims = range(size[0]["n"])
    bins = max(1, int(MAX_CELLS ** (1 / len(dims)) + 1e-9))
    shares = [i / bins for i in range(1, bins)]
    cuts = items.agg(*[F.percentile_approx(F.col("features")[j], F.array(*map(F.lit, shares)), 1000).alias(f"c{j}") for j in dims]).first() if shares else None
    cell = F.lit(0).cast("bigint")
    for j in dims:
        for c in cuts[j] if cuts else []:
            cell = cell + F.when(F.col("features")[j] > F.lit(c).cast("float"), bins**j).otherwise(0)
    placed = stored(items.select("id", "features", cell.alias("box")), "items")
    norm = F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    boxes = placed.groupBy("box").agg(
        F.array(*[F.min(F.col("features")[j]) for j in dims]).alias("low"), F.array(*[F.max(F.col("features")[j]) for j in dims]).alias("high"),
        F.max_by("features", F.struct(norm, "id")).alias("one")).orderBy("box").collect()  # at most MAX_CELLS rows
    names = np.array([b["box"] for b in boxes], np.int64)
    low, high, one = (np.array([b[c] for b in boxes], np.float64) for c in ("low", "high", "one"))
    most = float(np.sqrt((np.maximum(np.abs(low), np.abs(high)) ** 2).sum(axis=1).max()))

    def look(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _flat(batch, 1)
            for a in range(0, len(u), USERS_AT_ONCE):
                some = u[a:a + USERS_AT_ONCE]
                bound = np.maximum(some, 0) @ high.T + np.minimum(some, 0) @ low.T
                if len(one) >= k:
                    real = some @ one.T
                    least = np.partition(real, len(one) - k, axis=1)[:, len(one) - k]
                else:
                    least = np.full(len(some), -np.inf)
                slack = 1e-5 * most * np.sqrt((some**2).sum(axis=1))  # ratings are single precision
                i, j = np.nonzero(bound >= (least - slack)[:, None])
                rows = batch.take(pa.array(a + i))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[j])], ["query", "_q", "box"])

    kind = dict(users.dtypes)["id"]
    looking = users.select("id", F.col("features").cast("array<float>")).mapInArrow(look, f"query {kind}, _q array<float>, box bigint")
    looking = looking.select("query", "_q", (F.col("box") * SALTS + F.pmod(F.xxhash64("query"), F.lit(SALTS))).alias("cell"))
    salt = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    there = placed.select(F.col("id").alias("key"), "box", F.col("features").alias("_v"), salt).select("key", "_v", (F.col("box") * SALTS + F.col("salt")).alias("cell"))

    def best(q: np.ndarray, ranks: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = q @ v.T
        if len(v) > k:
            slack = 1e-5 * np.sqrt((q**2).sum(axis=1) * (v**2).sum(axis=1).max())
            least = np.partition(found, len(v) - k, axis=1)[:, len(v) - k] - slack
        else:
            least = np.full(len(q), -np.inf)
        i, j = np.nonzero(found >= least[:, None])
        rating = np.cumsum(q[i].astype(np.float32) * v[j].astype(np.float32), axis=1, dtype=np.float32)[:, -1]
        i, j, low_first = first_of_each(i, j, -rating.astype(np.float64), ranks, k)
        return i, j, -low_first

    met = picked_in_cells(there, looking, best)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("value"), "key"))
    return met.withColumn("place", place).where(F.col("place") <= k).select(
        F.col("query").alias("user"), F.col("key").alias("item"), F.col("value").cast("float").alias("rating"))
