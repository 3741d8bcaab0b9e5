"""Boosted regression trees from counts of cells.

Trees split features at borders that are chosen once, at most ``bins`` - 1 of each, so rows in the
same bins of all features take the same way through every tree. Splits and leaves of the library's
trees follow from the number, sum and squares of the labels of these cells; only those come to the
driver, and no row is kept in memory. A round of squared loss needs no pass over the rows at all,
one of absolute loss one pass, which counts labels below their cell's prediction.

For few features: there are up to ``bins`` to the power of their number of cells.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLED = 10_000  # rows from which borders are chosen, about, as the library does
EPSILON = np.finfo(float).eps


def borders(rows: DataFrame, features: list[str], n: int, bins: int, seed: int) -> list[np.ndarray]:
    """The borders between bins of each feature, as the library chooses them."""
    wanted = max(bins * bins, SAMPLED)
    share = wanted / n if wanted < n else 1.0
    some = rows.select(*features)
    if share < 1:
        # the library's own draw: by place in the partition
        session = some.sparkSession
        draw = session._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = some._jdf.rdd().sample(False, share, draw)
        some = DataFrame(session._jsparkSession.createDataFrame(drawn, some._jdf.schema()), session)
    drawn = np.array([tuple(r) for r in some.collect()], float).reshape(-1, len(features))
    total, most, out = share * n, min(bins, n) - 1, []
    for column in drawn.T:
        values, counts = np.unique(column[column != 0], return_counts=True)
        counts = counts.astype(float)
        if total - counts.sum() > EPSILON * n * 100:  # zeros are what is missing of the expected number
            at = int(np.searchsorted(values, 0.0))
            values, counts = np.insert(values, at, 0.0), np.insert(counts, at, total - counts.sum())
        middles = (values[:-1] + values[1:]) / 2
        if len(middles) > most:
            stride = target = total / (most + 1)
            kept = []
            for i, (before, now) in enumerate(pairwise(np.cumsum(counts))):
                if abs(before - target) < abs(now - target):
                    kept.append(middles[i])
                    target += stride
            middles = np.array(kept)
        out.append(middles)
    return out


def _bin(column: Column, cuts: np.ndarray, first: int = 0) -> Column:
    """How many cuts are below the value, found by halving."""
    if not len(cuts):
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(column <= float(cuts[half]), _bin(column, cuts[:half], first)).otherwise(_bin(column, cuts[half + 1:], first + half + 1))


def _impurity(n, s, q):
    return (q - s * s / n) / n


def grown(cells: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, cuts: list[np.ndarray], depth: int):
    """A tree for the cells' labels: their mean, or (feature, cut, tree of the bins up to it, tree of the others)."""
    total, sum_, squares = n.sum(), s.sum(), q.sum()
    mean, own = sum_ / total, _impurity(total, sum_, squares)
    if not depth:
        return mean
    best = (0.0, None, None)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        left = [np.cumsum(np.bincount(cells[:, j], weights=x, minlength=len(c) + 1))[:-1] for x in (n, s, q)]
        right = [total - left[0], sum_ - left[1], squares - left[2]]
        fits = (left[0] > 0) & (right[0] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, own - left[0] / total * _impurity(*left) - right[0] / total * _impurity(*right), -np.inf)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], j, at)
    _, j, at = best
    if j is None:
        return mean
    below = cells[:, j] <= at

    def side(of):
        flat = abs(_impurity(n[of].sum(), s[of].sum(), q[of].sum())) < EPSILON
        return grown(cells[of], n[of], s[of], q[of], cuts, 0 if flat else depth - 1)

    return j, at, side(below), side(~below)


def _of_cells(tree, cells: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(cells), tree)
    j, at, low, high = tree
    return np.where(cells[:, j] <= at, _of_cells(low, cells), _of_cells(high, cells))


def _of_rows(tree, columns: list[Column], cuts: list[np.ndarray]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    j, at, low, high = tree
    return F.when(columns[j] <= float(cuts[j][at]), _of_rows(low, columns, cuts)).otherwise(_of_rows(high, columns, cuts))


def boosted(df: DataFrame, label: str, features: list[str], losses: list[str], rounds: int, depth: int, bins: int = 32, rate: float = 0.1, seed: int = 1) -> dict[str, Column]:
    """For each loss, "squared" or "absolute", the prediction as a column of ``features``: the trees of the library's ``GBTRegressor``.

    Raises where there are no rows, or where a feature or label is null or not a number.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"f{j}") for j, c in enumerate(features)], F.col(label).cast("double").alias("y"))
    names = [f"f{j}" for j in range(len(features))]
    odd = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in (*names, "y")])
    n, unfit = rows.agg(F.count("*"), F.count_if(odd)).first()
    if not n or unfit:
        raise ValueError(f"training needs rows, and numbers in all of them: {n} rows, {unfit} with a null or NaN")
    cuts = borders(rows, names, n, bins, seed)
    sizes = [len(c) + 1 for c in cuts]
    cell = reduce(lambda a, b: a + b, [_bin(F.col(c), x) * int(np.prod(sizes[:j])) for j, (c, x) in enumerate(zip(names, cuts))])
    placed = rows.withColumn("cell", cell)
    found = placed.groupBy("cell").agg(F.count("*"), F.sum("y"), F.sum(F.col("y") * F.col("y"))).collect()
    table = np.array([tuple(r) for r in found], float)
    table = table[table[:, 0].argsort()]
    ids, (count, sums, squares) = table[:, 0].astype(np.int64), table[:, 1:].T
    cells = np.stack(np.unravel_index(ids, sizes, order="F"), axis=1)
    first = grown(cells, count, sums, squares, cuts, depth)

    def predicted(trees: list, columns: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [_of_rows(x, columns, cuts) * (rate if i else 1.0) for i, x in enumerate(trees)])

    def residuals(loss: str, trees: list) -> tuple[np.ndarray, np.ndarray]:
        """Sum and squares, per cell, of what the next tree learns."""
        if loss == "squared":
            now = sum(_of_cells(x, cells) * (rate if i else 1.0) for i, x in enumerate(trees))
            return 2 * (sums - count * now), 4 * (squares - 2 * now * sums + count * now * now)
        below = placed.where(F.col("y") - predicted(trees, [F.col(c) for c in names]) < 0).groupBy("cell").agg(F.count("*")).collect()
        under = np.zeros(len(ids))
        under[np.searchsorted(ids, [r[0] for r in below])] = [r[1] for r in below]
        return count - 2 * under, count

    out = {}
    for loss in losses:
        trees = [first]
        for _ in range(rounds - 1):
            trees.append(grown(cells, count, *residuals(loss, trees), cuts, depth))
        out[loss] = predicted(trees, [F.col(c).cast("double") for c in features])
    return out
