"""Evaluation of predictions as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_running_totals


def binary_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score, best first: true and false positives at that threshold.

    Equal scores are counted first; the running totals cross partitions by offsets, so a third of
    the rows may share one score.
    """
    per_score = df.groupBy(score).agg(
        F.sum(F.col(label)).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    run = with_running_totals(per_score, [F.desc(score)], {"tp": "pos", "fp": "neg"})
    totals = df.agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    return run.crossJoin(F.broadcast(totals)).select(  # one row
        score, "pos", "neg", "tp", "fp", (F.col("tp") / F.col("p")).alias("recall"), (F.col("fp") / F.col("n")).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))).alias("f1"), "p", "n")


def area_under_roc(curve: DataFrame) -> DataFrame:
    """Trapezoids: each score group is one step of ``neg`` to the right and ``pos`` up."""
    step = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return curve.agg((F.sum(step) / (F.max("p") * F.max("n"))).alias("area"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, weight) from a confusion table."""
    cells = matrix.select("n", F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.lit("label").alias("role")), F.struct(F.col("predicted").alias("c"), F.lit("predicted").alias("role")))).alias("e"),
        (F.col("label") == F.col("predicted")).alias("hit"))
    per_class = cells.groupBy(F.col("e.c").alias("label")).agg(
        F.sum(F.when(F.col("e.role") == "label", F.col("n")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col("e.role") == "predicted", F.col("n")).otherwise(0)).alias("guessed"),
        F.sum(F.when(F.col("hit") & (F.col("e.role") == "label"), F.col("n")).otherwise(0)).alias("hits"))
    total = matrix.agg(F.sum("n").alias("total"))
    precision = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("actual") > 0, F.col("hits") / F.col("actual")).otherwise(0.0)
    both = F.col("guessed") + F.col("actual")
    return per_class.crossJoin(F.broadcast(total)).select(  # one row
        "label", precision.alias("precision"), recall.alias("recall"),
        F.when(both > 0, 2 * F.col("hits") / both).otherwise(0.0).alias("f1"), (F.col("actual") / F.col("total")).alias("weight"))


def regression(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """MSE, RMSE, MAE, R2 and explained variance in one pass over the rows."""
    y, e = F.col(label), F.col(label) - F.col(predicted)
    sums = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_vy"),
                  F.avg(y).alias("_my"), F.avg(predicted).alias("_mp"), F.var_pop(predicted).alias("_vp"))
    shift = F.col("_mp") - F.col("_my")
    return sums.select(
        "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.col("mse") / F.col("_vy")).alias("r2"),
        (F.col("_vp") + shift * shift).alias("explained"))


def multilabel(df: DataFrame, key: str, label: str, actual: Column, predicted: Column) -> DataFrame:
    """Per-document and pooled metrics from rows (key, label): was it there, was it predicted?"""
    flags = df.groupBy(key, label).agg(F.max(actual.cast("int")).alias("a"), F.max(predicted.cast("int")).alias("p"))
    per = flags.groupBy(key).agg(
        F.sum("a").alias("a"), F.sum("p").alias("p"), F.sum(F.col("a") * F.col("p")).alias("both"),
        F.sum(F.greatest("a", "p")).alias("any"))

    def share(top, below):
        return F.when(below > 0, top / below).otherwise(0.0)

    a, p, both = F.col("a"), F.col("p"), F.col("both")
    return per.agg(
        F.avg((a == p).cast("int") * (a == both).cast("int")).alias("subset_accuracy"), F.avg(share(both, F.col("any"))).alias("accuracy"),
        F.avg(share(both, p)).alias("precision"), F.avg(share(both, a)).alias("recall"), F.avg(share(2 * both, a + p)).alias("f1"),
        (F.sum(both) / F.sum(p)).alias("micro_precision"), (F.sum(both) / F.sum(a)).alias("micro_recall"),
        (2 * F.sum(both) / (F.sum(a) + F.sum(p))).alias("micro_f1"))


def ranking(ranked: DataFrame, key: str, place: str, relevant: str, k: int) -> DataFrame:
    """Precision at k, mean average precision and NDCG at k.

    ``ranked`` has one row per recommended or relevant item: ``place`` from 1 (NULL if it was not
    recommended) and ``relevant`` true or false.
    """
    from pyspark.sql.window import Window

    before = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col(relevant) & F.col(place).isNotNull()
    rows = ranked.withColumn("_hits", F.sum(F.when(hit, 1).otherwise(0)).over(before))
    gain = F.when(hit & (F.col(place) <= k), 1 / F.log2(F.col(place) + 1)).otherwise(0.0)
    per = rows.groupBy(key).agg(
        F.sum(F.when(F.col(relevant), 1).otherwise(0)).alias("_rel"),
        F.sum(F.when(hit & (F.col(place) <= k), 1).otherwise(0)).alias("_top"),
        F.sum(F.when(hit, F.col("_hits") / F.col(place)).otherwise(0.0)).alias("_ap"), F.sum(gain).alias("_dcg"))
    kept = per.where("_rel > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return kept.agg(
        F.avg(F.col("_top") / k).alias("precision_at_k"), F.avg(F.col("_ap") / F.col("_rel")).alias("map"), F.avg(F.col("_dcg") / ideal).alias("ndcg"))
