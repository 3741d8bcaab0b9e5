"""Models trained by rounds of aggregates, for tables and for streams.

Only sums with one value per feature (and class or cluster) come to the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch


def _dot(weights: np.ndarray, features: list[str]) -> Column:
    total = F.lit(float(weights[0]))
    for w, c in zip(weights[1:], features):
        total = total + F.lit(float(w)) * F.col(c)
    return total


def _gradient(df: DataFrame, error: Column, features: list[str]) -> tuple[np.ndarray, int]:
    """Mean of error * (1, features): one aggregate, one row."""
    scored = df.withColumn("_e", error)
    sums = scored.agg(
        F.count("_e").alias("n"), F.sum("_e").alias("g0"), *[F.sum(F.col("_e") * F.col(c)).alias(f"g_{c}") for c in features]).first()
    n = sums["n"]
    if not n:
        return np.zeros(len(features) + 1), 0
    return np.array([sums["g0"], *[sums[f"g_{c}"] for c in features]]) / n, n


def logistic_gradient_descent(df: DataFrame, label: str, features: list[str], rounds: int, step: float) -> tuple[np.ndarray, list[float]]:
    """Weights (intercept first) and the size of the gradient in each round."""
    kept = df.select(F.col(label).cast("double").alias(label), *features).persist()
    weights, sizes = np.zeros(len(features) + 1), []
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_dot(weights, features)))
        g, _n = _gradient(kept, p - F.col(label), features)
        weights = weights - step * g
        sizes.append(float(np.linalg.norm(g)))
    kept.unpersist()
    return weights, sizes


class StreamingLinear:
    """Linear or logistic regression updated by every micro-batch."""

    def __init__(self, label: str, features: list[str], step: float, rounds: int = 5, logistic: bool = False):
        self.label, self.features, self.step, self.rounds, self.logistic = label, features, step, rounds, logistic
        self.weights = np.zeros(len(features) + 1)
        self.history: list[tuple[int, int, list[float]]] = []

    def predict(self) -> Column:
        z = _dot(self.weights, self.features)
        return 1 / (1 + F.exp(-z)) if self.logistic else z

    def update(self, batch: DataFrame, number: int) -> None:
        kept = batch.select(F.col(self.label).cast("double").alias(self.label), *self.features).persist()
        n = 0
        for i in range(self.rounds):
            g, n = _gradient(kept, self.predict() - F.col(self.label), self.features)
            self.weights = self.weights - self.step / np.sqrt(i + 1) * g
        kept.unpersist()
        self.history.append((number, n, [float(w) for w in self.weights]))


class StreamingKMeans:
    """Centres moved by every micro-batch; older weight fades by ``decay``."""

    def __init__(self, centres: np.ndarray, decay: float = 1.0):
        self.centres, self.decay = centres, decay
        self.weights = np.zeros(len(centres))
        self.history: list[tuple[int, int, float]] = []

    def sums(self, batch: DataFrame, column: str) -> DataFrame:
        """(cluster, n, s): per task and cluster one vector sum, so shuffled rows do not grow with the data."""
        centres = self.centres

        def assign(batches):
            total, count = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
            for b in batches:
                rows = b.column(0)
                if len(rows) == 0:
                    continue
                x = np.asarray(rows.flatten(), dtype=np.float64).reshape(len(rows), -1)
                nearest = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
                np.add.at(total, nearest, x)
                count += np.bincount(nearest, minlength=len(centres))
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(range(len(centres)), pa.int32()), "n": pa.array(count), "s": pa.array(total.tolist(), pa.list_(pa.float64()))})

        parts = batch.select(F.col(column).cast("array<double>")).mapInArrow(assign, "cluster int, n bigint, s array<double>")
        long = parts.select("cluster", "n", F.posexplode("s").alias("j", "x"))
        cells = long.groupBy("cluster", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        return cells.groupBy("cluster").agg(
            F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("s"))

    def update(self, batch: DataFrame, number: int, column: str) -> None:
        moved = 0.0
        rows = self.sums(batch, column).collect()  # one row per cluster
        for r in rows:
            if r.n:
                old = self.weights[r.cluster] * self.decay
                new = (self.centres[r.cluster] * old + np.array(r.s)) / (old + r.n)
                moved = max(moved, float(np.linalg.norm(new - self.centres[r.cluster])))
                self.centres[r.cluster], self.weights[r.cluster] = new, old + r.n
        self.history.append((number, sum(r.n for r in rows), moved))


def train_on(stream: DataFrame, update) -> None:
    """Feed every micro-batch to ``update(batch, number)``."""
    stream.writeStream.foreachBatch(update).option(
        "checkpointLocation", scratch(stream.sparkSession, "train")).trigger(availableNow=True).start().awaitTermination()


# ---- counts behind models -------------------------------------------------------------------


def impurities(df: DataFrame, node: str, label: str) -> DataFrame:
    """Gini and entropy of the label in every node, from label counts."""
    counts = df.groupBy(node, label).agg(F.count("*").alias("n"))
    sums = counts.groupBy(node).agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("n") * F.log2("n")).alias("l"))
    t = F.col("total")
    return sums.select(
        node, "total", (1 - F.col("q") / (t * t)).alias("gini"), (F.log2(t) - F.col("l") / t).alias("entropy"))


def frequent_itemsets(baskets: DataFrame, basket: str, item: str, share: float) -> DataFrame:
    """(items, n): sets of items of any size that at least ``share`` of the baskets hold, by FP-growth on frequent items.

    Items are sorted. Infrequent ones are dropped first; baskets are conditioned by Spark's
    parallel FP-growth, so a basket's sets are never written out.
    """
    from pyspark.ml.fpm import FPGrowth

    items = baskets.select(basket, item).distinct()
    total = items.agg(F.countDistinct(basket)).first()[0]
    least = share * total
    frequent = items.groupBy(item).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(item)
    lists = items.join(frequent, item).groupBy(basket).agg(F.collect_set(item).alias("items"))
    kept = max(1, lists.count())  # baskets that still hold an item
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (least - 0.5) / kept)), minConfidence=0.0).fit(lists)
    return model.freqItemsets.where(F.col("freq") >= least).select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))


def frequent_pairs(baskets: DataFrame, basket: str, item: str, share: float) -> DataFrame:
    """(a, b, n) of the frequent itemsets of two items, with a < b."""
    pairs = frequent_itemsets(baskets, basket, item, share).where(F.size("items") == 2)
    return pairs.select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "n")


def rules(itemsets: DataFrame, confidence: float) -> DataFrame:
    """(antecedent, consequent, confidence) of all frequent itemsets: one item follows from the others."""
    whole = itemsets.select("items", "n", F.explode("items").alias("consequent"))
    split = whole.select(F.array_remove("items", F.col("consequent")).alias("antecedent"), "consequent", "n").where(F.size("antecedent") > 0)
    of = itemsets.select(F.col("items").alias("antecedent"), F.col("n").alias("_n"))
    return split.join(of, "antecedent").select(
        "antecedent", "consequent", (F.col("n") / F.col("_n")).alias("confidence")).where(F.col("confidence") >= confidence)


def naive_bayes_counts(df: DataFrame, label: str, features: list[str], smoothing: float = 1.0) -> DataFrame:
    """(label, prior, one log probability per feature): the multinomial model from two sums."""
    sums = df.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in features])
    totals = df.agg(F.count("*").alias("_t"), F.countDistinct(label).alias("_k"))
    all_ = reduce(lambda a, b: a + b, [F.col(c) for c in features])
    return sums.crossJoin(F.broadcast(totals)).select(  # one row
        label, (F.ln(F.col("n") + smoothing) - F.ln(F.col("_t") + F.col("_k") * smoothing)).alias("prior"),
        *[(F.ln(F.col(c) + smoothing) - F.ln(all_ + smoothing * len(features))).alias(c) for c in features])
