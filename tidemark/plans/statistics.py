"""Evaluation, statistics and distributed matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import evaluation as E
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import ChiSquareTest, KolmogorovSmirnovTest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.ml import linalg, metrics, significance as tests
from tidemark.registry import query
from tidemark.streaming.runner import file_stream, run_complete

# quality of a document, guessed by its length
SCORED = "(SELECT quality AS y, n_chars // 50 AS s FROM labels JOIN documents USING (doc_id))"


def scored(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("y"), F.expr("n_chars div 50").alias("s"))


CURVE = f"""(SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
    FROM (SELECT s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {SCORED} GROUP BY 1))"""


@query("ev01_binary_metrics", f"""
    SELECT s, round(tp / p, 9) AS recall, round(fp / n, 9) AS fpr, round(tp / (tp + fp), 9) AS precision, round(2 * tp / (tp + fp + p), 9) AS f1 FROM {CURVE}""")
def _(t):
    curve = metrics.binary_curve(scored(t), "s", "y")
    return curve.select("s", *[F.round(c, 9).alias(c) for c in ("recall", "fpr", "precision", "f1")])


@query("ev02_area_under_curve", f"SELECT round(sum((x - x0) * (y + y0) / 2), 9) AS area FROM (SELECT tp / p AS y, fp / n AS x, lag(tp / p, 1, 0.0) OVER (ORDER BY s DESC) AS y0, lag(fp / n, 1, 0.0) OVER (ORDER BY s DESC) AS x0 FROM {CURVE})")
def _(t):
    return metrics.area_under_roc(metrics.binary_curve(scored(t), "s", "y")).select(F.round("area", 9).alias("area"))


GUESS = "SELECT CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS y, CAST(1 + floor(o_totalprice / 100001) AS INTEGER) AS p FROM orders"


def guessed(t):
    return t.orders.select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("y"), (1 + F.floor(F.col("o_totalprice") / 100001)).cast("int").alias("p"))


@query("ev03_confusion", f"SELECT y AS label, p AS predicted, count(*) AS n FROM ({GUESS}) GROUP BY 1, 2")
def _(t):
    return metrics.confusion(guessed(t), "y", "p")


@query("ev03_class_metrics", f"""
    WITH g AS ({GUESS}), c AS (SELECT unnest([1, 2, 3, 4, 5]) AS label)
    SELECT label, round((SELECT count(*) FROM g WHERE y = label AND p = label) / (SELECT count(*) FROM g WHERE p = label), 9) AS precision,
           round((SELECT count(*) FROM g WHERE y = label AND p = label) / (SELECT count(*) FROM g WHERE y = label), 9) AS recall,
           round((SELECT count(*) FROM g WHERE y = label) / (SELECT count(*) FROM g), 9) AS weight FROM c""")
def _(t):
    found = metrics.class_metrics(metrics.confusion(guessed(t), "y", "p"))
    return found.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "weight")])


@query("ev04_multilabel", """
    WITH f AS (SELECT l_orderkey, l_returnflag, max(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS a, max(CASE WHEN l_extendedprice > 30000 THEN 1 ELSE 0 END) AS p FROM lineitem GROUP BY 1, 2),
    d AS (SELECT l_orderkey, sum(a) AS a, sum(p) AS p, sum(a * p) AS b, sum(greatest(a, p)) AS u FROM f GROUP BY 1)
    SELECT round(avg(CASE WHEN a = p AND a = b THEN 1.0 ELSE 0.0 END), 9) AS subset_accuracy, round(avg(CASE WHEN u > 0 THEN b / u ELSE 0 END), 9) AS accuracy,
           round(avg(CASE WHEN p > 0 THEN b / p ELSE 0 END), 9) AS precision, round(avg(CASE WHEN a > 0 THEN b / a ELSE 0 END), 9) AS recall,
           round(avg(CASE WHEN a + p > 0 THEN 2 * b / (a + p) ELSE 0 END), 9) AS f1, round(sum(b) / sum(p), 9) AS micro_precision,
           round(sum(b) / sum(a), 9) AS micro_recall, round(2 * sum(b) / (sum(a) + sum(p)), 9) AS micro_f1 FROM d""")
def _(t):
    found = metrics.multilabel(t.lineitem, "l_orderkey", "l_returnflag", F.col("l_quantity") > 10, F.col("l_extendedprice") > 30000)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query("ev05_ranking", """
    WITH r AS (SELECT l_orderkey, l_quantity > 30 AS rel, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem),
    h AS (SELECT *, sum(CASE WHEN rel THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY place) AS hits FROM r),
    d AS (SELECT l_orderkey, sum(CASE WHEN rel THEN 1 ELSE 0 END) AS n, sum(CASE WHEN rel AND place <= 3 THEN 1 ELSE 0 END) AS top, sum(CASE WHEN rel THEN hits / place ELSE 0 END) AS ap,
          sum(CASE WHEN rel AND place <= 3 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1 HAVING n > 0)
    SELECT round(avg(top / 3), 9) AS precision_at_k, round(avg(ap / n), 9) AS map,
           round(avg(dcg / CASE least(n, 3) WHEN 1 THEN 1 WHEN 2 THEN 1 + 1 / log2(3) ELSE 1 + 1 / log2(3) + 1 / log2(4) END), 9) AS ndcg FROM d""")
def _(t):
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    ranked = t.lineitem.select("l_orderkey", (F.col("l_quantity") > 30).alias("rel"), F.row_number().over(by).alias("place"))
    found = metrics.ranking(ranked, "l_orderkey", "place", "rel", 3)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query("ev06_regression_metrics", """
    WITH g AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)
    SELECT round(avg((y - p) ** 2), 2) AS mse, round(sqrt(avg((y - p) ** 2)), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae,
           round(1 - avg((y - p) ** 2) / var_pop(y), 9) AS r2, round(var_pop(p) + (avg(p) - avg(y)) ** 2, 2) AS explained FROM g""")
def _(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))
    found = metrics.regression(rows, "y", "p")
    return found.select(F.round("mse", 2).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), F.round("r2", 9).alias("r2"), F.round("explained", 2).alias("explained"))


LONG = "(SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64))::INTEGER AS j FROM embeddings)"


@query("ev07_column_summary", f"""
    SELECT j, count(*) AS n, round(avg(x), 9) AS mean, round(var_samp(x), 9) AS variance, min(x) AS lowest, max(x) AS highest,
           count(*) FILTER (WHERE x <> 0) AS nonzero, round(sum(abs(x)), 6) AS norm1, round(sqrt(sum(x * x)), 6) AS norm2 FROM {LONG} GROUP BY 1""")
def _(t):
    s = linalg.column_sums(t.embeddings, "embedding")
    mean = F.col("s") / F.col("n")
    return s.select(
        "j", "n", F.round(mean, 9).alias("mean"), F.round((F.col("squares") - F.col("n") * mean * mean) / (F.col("n") - 1), 9).alias("variance"),
        "lowest", "highest", "nonzero", F.round("absolute", 6).alias("norm1"), F.round(F.sqrt("squares"), 6).alias("norm2"))


@query("ev08_pearson_matrix", f"SELECT a.j AS i, b.j AS j, round(corr(a.x, b.x), 9) AS v FROM {LONG} AS a JOIN {LONG} AS b USING (vec_id) GROUP BY 1, 2")
def _(t):
    return linalg.correlation(t.embeddings, "embedding").withColumn("v", F.round("v", 9))


@query("ev09_spearman", """
    WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
        rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
    SELECT round(corr(a, b), 9) AS rho FROM r""")
def _(t):
    return tests.spearman(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("rho", 9).alias("rho"))


@query("ev10_chi_squared", """
    WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2),
    e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM c),
    f AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), g AS (SELECT n, avg(n) OVER () AS x FROM f)
    SELECT 'independence' AS kind, round(sum((n - x) ** 2 / x), 6) AS statistic, 8::BIGINT AS degrees FROM e
    UNION ALL SELECT 'fit', round(sum((n - x) ** 2 / x), 6), 4 FROM g""")
def _(t):
    a = tests.chi_squared_independence(t.orders, "o_orderstatus", "o_orderpriority")
    b = tests.chi_squared_fit(t.events, "event_type")
    return a.select(F.lit("independence").alias("kind"), F.round("statistic", 6).alias("statistic"), "degrees").union(
        b.select(F.lit("fit"), F.round("statistic", 6), "degrees"))


@query("ev10_chi_squared_p_value")
def _(t):
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    indexed = StringIndexer(inputCols=["o_orderstatus", "o_orderpriority"], outputCols=["a", "b"]).fit(t.orders).transform(t.orders)
    found = ChiSquareTest.test(VectorAssembler(inputCols=["b"], outputCol="v").transform(indexed), "v", "a", flatten=True)
    return found.select("pValue", "degreesOfFreedom", "statistic")


@query("ev11_kolmogorov_smirnov", """
    WITH c AS (SELECT o_totalprice AS x, count(*) AS k FROM orders GROUP BY 1),
    r AS (SELECT x, k, sum(k) OVER (ORDER BY x) AS u, sum(k) OVER () AS n FROM c)
    SELECT round(max(greatest(abs(u / n - x / 500000), abs(x / 500000 - (u - k) / n))), 9) AS statistic FROM r""")
def _(t):
    return tests.kolmogorov_smirnov(t.orders, "o_totalprice", lambda x: x / 500000).select(F.round("statistic", 9).alias("statistic"))


@query("ev11_kolmogorov_smirnov_normal")
def _(t):
    mean, dev = t.orders.agg(F.avg("o_totalprice"), F.stddev_pop("o_totalprice")).first()
    return KolmogorovSmirnovTest.test(t.orders, "o_totalprice", "norm", mean, dev)


POINTS = [0.0, 2500.0, 5000.0, 7500.0]


@query("ev12_kernel_density", f"""
    SELECT point, round(avg(exp(-(((c_acctbal - point) / 800) ** 2) / 2)) / (800 * sqrt(2 * pi())), 12) AS density
    FROM customer, (SELECT unnest([0.0, 2500.0, 5000.0, 7500.0])::DOUBLE AS point) GROUP BY 1""")
def _(t):
    return tests.kernel_density(t.customer, "c_acctbal", POINTS, 800.0).withColumn("density", F.round("density", 12))


@query("ev13_streaming_significance", """
    WITH g AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, user_id % 2 = 1 AS b, value AS x FROM events),
    s AS (SELECT day, count(x) FILTER (WHERE b) AS n1, avg(x) FILTER (WHERE b) AS m1, var_samp(x) FILTER (WHERE b) AS v1,
          count(x) FILTER (WHERE NOT b) AS n0, avg(x) FILTER (WHERE NOT b) AS m0, var_samp(x) FILTER (WHERE NOT b) AS v0 FROM g GROUP BY 1)
    SELECT day, n1, n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS welch_t,
           round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)), 6) AS student_t FROM s""")
def _(t):
    """Group sums are kept by the stream; the statistic is an expression on the last result."""
    b = F.col("user_id") % 2 == 1
    x1, x0 = F.when(b, F.col("value")), F.when(~b, F.col("value"))
    daily = file_stream(t, "events").groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count(x1).alias("n1"), F.avg(x1).alias("m1"), F.var_samp(x1).alias("v1"), F.count(x0).alias("n0"), F.avg(x0).alias("m0"), F.var_samp(x0).alias("v0"))
    done = tests.t_statistic(run_complete(daily.select("w.start", "n1", "m1", "v1", "n0", "m0", "v0")))
    return done.select(F.col("start").cast("timestamp_ntz").alias("day"), "n1", "n0", F.round("welch_t", 6).alias("welch_t"), F.round("student_t", 6).alias("student_t"))


@query("ev14_gaussian_density", """
    WITH m AS (SELECT avg(c_acctbal / 1000) AS a, avg(c_nationkey) AS b, var_samp(c_acctbal / 1000) AS p, var_samp(c_nationkey) AS q, covar_samp(c_acctbal / 1000, c_nationkey) AS r FROM customer)
    SELECT c_custkey, round(exp(-((x - a) ** 2 * q - 2 * (x - a) * (y - b) * r + (y - b) ** 2 * p) / (2 * (p * q - r * r))) / (2 * pi() * sqrt(p * q - r * r)), 9) AS density
    FROM (SELECT c_custkey, c_acctbal / 1000 AS x, c_nationkey AS y FROM customer), m""")
def _(t):
    """Mean and covariance are one aggregate; the density is evaluated in Arrow batches."""
    rows = t.customer.select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    s = rows.agg(F.avg("x"), F.avg("y"), F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")).first()
    mean, cov = np.array(s[:2]), np.array([[s[2], s[4]], [s[4], s[3]]])
    inverse, scale = np.linalg.inv(cov), 1 / (2 * math.pi * math.sqrt(np.linalg.det(cov)))

    @F.pandas_udf("double")
    def density(x: pd.Series, y: pd.Series) -> pd.Series:
        d = np.column_stack([x, y]) - mean
        return pd.Series(scale * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, inverse, d)))

    return rows.select("c_custkey", F.round(density("x", "y"), 9).alias("density"))


ENTRIES = "(SELECT l_suppkey AS i, l_linenumber::BIGINT - 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def entries(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("i"), (F.col("l_linenumber").cast("bigint") - 1).alias("j")).agg(F.sum("l_quantity").alias("v"))


@query("ev15_coordinate_matrix", f"SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) AS v FROM {ENTRIES} AS a JOIN {ENTRIES} AS b ON a.i = b.i GROUP BY 1, 2")
def _(t):
    m = entries(t)
    return linalg.multiply(linalg.transpose(m), m).withColumn("v", F.round("v", 4))


@query("ev15_indexed_rows", f"SELECT i, coalesce(sum(v) FILTER (WHERE j = 0), 0) AS first, coalesce(sum(v) FILTER (WHERE j = 6), 0) AS last FROM {ENTRIES} GROUP BY 1")
def _(t):
    rows = linalg.to_indexed_rows(entries(t), 7)
    return rows.select("i", F.col("row")[0].alias("first"), F.col("row")[6].alias("last"))


@query("ev16_gramian", f"SELECT a.j AS i, b.j AS j, round(sum(a.x * b.x), 6) AS v FROM {LONG} AS a JOIN {LONG} AS b USING (vec_id) GROUP BY 1, 2")
def _(t):
    return linalg.gramian(t.embeddings, "embedding").withColumn("v", F.round("v", 6))


@query("ev16_times_local", f"SELECT vec_id, round(sum(x * (j + 1)), 6) AS a, round(sum(x * (j % 2)), 6) AS b FROM {LONG} GROUP BY 1")
def _(t):
    weights = np.column_stack([np.arange(64) + 1.0, np.arange(64) % 2])
    done = linalg.times_local(t.embeddings.select("vec_id", "embedding"), "embedding", weights, "p")
    return done.select("vec_id", F.round(F.col("p")[0], 6).alias("a"), F.round(F.col("p")[1], 6).alias("b"))


@query("ev17_svd")
def _(t):
    values, vectors = linalg.svd(t.embeddings, "embedding", 64, 5)
    return t.spark.createDataFrame([(i, float(v), [float(x) for x in vectors[:, i]]) for i, v in enumerate(values)], "k int, singular double, v array<double>")


@query("ev18_evaluators")
def _(t):
    g = guessed(t).select(F.col("y").cast("double").alias("label"), F.col("p").cast("double").alias("prediction"))
    b = scored(t).select(F.col("y").cast("double").alias("label"), F.col("s").cast("double").alias("rawPrediction"))
    rows = [(m, E.MulticlassClassificationEvaluator(metricName=m).evaluate(g)) for m in ("accuracy", "weightedPrecision", "f1")]
    rows += [(m, E.BinaryClassificationEvaluator(metricName=m).evaluate(b)) for m in ("areaUnderROC", "areaUnderPR")]
    rows += [(m, E.RegressionEvaluator(metricName=m).evaluate(g)) for m in ("rmse", "mae", "r2")]
    return t.spark.createDataFrame(rows, "metric string, value double")


@query("ev19_cluster_sizes")
def _(t):
    df = t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=5, seed=1, maxIter=10).fit(df).transform(df).groupBy("prediction").agg(F.count("*").alias("size"))
