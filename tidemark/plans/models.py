"""Models trained on a table and applied to it."""

from __future__ import annotations

import numpy as np
from pyspark.ml import classification as C, clustering as K, fpm, recommendation, regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from tidemark.ml import boosting, patterns, recommend, streaming, training
from tidemark.ml.text import all_words
from tidemark.registry import query
from tidemark.session import scratch, stored
from tidemark.streaming.runner import file_stream

FEATURES = ["l_quantity", "l_discount", "l_tax"]
ROWS_PER_PART = 1_000_000
RATINGS_PER_BLOCK = 2_000_000
LEAST_BLOCKS = 10  # as the library's


def regression_rows(t):
    rows = t.lineitem.select("l_orderkey", "l_suppkey", *FEATURES, (F.col("l_extendedprice") / 1000).alias("label"))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def in_parts(df, most):
    """``df`` in partitions of about ``most`` rows where they would be larger."""
    wanted = -(-df.count() // most)
    return df.repartition(wanted) if wanted > df.rdd.getNumPartitions() else df


def digits(t):
    """Ten classes of vectors."""
    return t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))


def halves(t):
    return digits(t).withColumn("label", (F.col("label") >= 5).cast("double"))


def coefficients(t, model, names=FEATURES):
    rows = [("intercept", float(model.intercept)), *[(n, float(c)) for n, c in zip(names, model.coefficients)]]
    return t.spark.createDataFrame(rows, "term string, value double")


def predictions(model, df, key="vec_id"):
    return model.transform(df).select(key, "label", "prediction")


@query("mo01_linear_regression", """
    SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice / 1000, l_quantity), 6) AS value FROM lineitem
    UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice / 1000, l_quantity), 6) FROM lineitem""")
def _(t):
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        t.lineitem.select("l_quantity", (F.col("l_extendedprice") / 1000).alias("label")))
    model = R.LinearRegression(solver="normal", regParam=0.0).fit(rows)
    return coefficients(t, model, ["l_quantity"]).withColumn("value", F.round("value", 6))


@query("mo01_elastic_net")
def _(t):
    return coefficients(t, R.LinearRegression(maxIter=10, regParam=0.3, elasticNetParam=0.8).fit(regression_rows(t)))


@query("mo02_linear_regression_iterative")
def _(t):
    return coefficients(t, R.LinearRegression(solver="l-bfgs", maxIter=20, regParam=0.0).fit(regression_rows(t)))


@query("mo03_ridge")
def _(t):
    return coefficients(t, R.LinearRegression(regParam=0.5, elasticNetParam=0.0).fit(regression_rows(t)))


@query("mo04_lasso")
def _(t):
    return coefficients(t, R.LinearRegression(regParam=0.5, elasticNetParam=1.0).fit(regression_rows(t)))


@query("mo05_generalized_linear")
def _(t):
    rows = regression_rows(t).where("label > 0")
    return coefficients(t, R.GeneralizedLinearRegression(family="gamma", link="log", maxIter=10).fit(rows))


@query("mo06_logistic_binary")
def _(t):
    return predictions(C.LogisticRegression(maxIter=10, regParam=0.01).fit(halves(t)), halves(t))


@query("mo06_logistic_multinomial")
def _(t):
    return predictions(C.LogisticRegression(maxIter=10, regParam=0.01, family="multinomial").fit(digits(t)), digits(t))


@query("mo07_linear_svm")
def _(t):
    return predictions(C.LinearSVC(maxIter=10, regParam=0.1).fit(halves(t)), halves(t))


FLAGS = ["n_a", "n_n", "n_r"]
FLAG_SQL = """(SELECT o_orderstatus AS label, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus)"""


def flag_rows(t):
    joined = t.orders.join(t.lineitem, F.expr("l_orderkey = o_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderstatus").agg(*[
        F.sum(F.when(F.col("l_returnflag") == f, 1).otherwise(0)).alias(c) for f, c in zip("ANR", FLAGS)])


@query("mo08_naive_bayes", f"""
    SELECT label, round(ln(count(*) + 1.0) - ln((SELECT count(*) FROM {FLAG_SQL}) + 3.0), 9) AS prior, round(ln(sum(a) + 1) - ln(sum(a + n + r) + 3), 9) AS n_a,
           round(ln(sum(n) + 1) - ln(sum(a + n + r) + 3), 9) AS n_n, round(ln(sum(r) + 1) - ln(sum(a + n + r) + 3), 9) AS n_r FROM {FLAG_SQL} GROUP BY 1""")
def _(t):
    model = training.naive_bayes_counts(flag_rows(t), "o_orderstatus", FLAGS)
    return model.select(F.col("o_orderstatus").alias("label"), *[F.round(c, 9).alias(c) for c in ["prior", *FLAGS]])


@query("mo08_naive_bayes_model")
def _(t):
    rows = flag_rows(t).withColumn("label", F.ascii("o_orderstatus").cast("double") % 3)
    df = VectorAssembler(inputCols=FLAGS, outputCol="features").transform(rows)
    return predictions(C.NaiveBayes(smoothing=1.0, modelType="multinomial").fit(df), df, "o_orderkey")


@query("mo08_naive_bayes_bernoulli")
def _(t):
    rows = flag_rows(t).withColumn("label", F.ascii("o_orderstatus").cast("double") % 3).withColumns({c: (F.col(c) > 0).cast("double") for c in FLAGS})
    df = VectorAssembler(inputCols=FLAGS, outputCol="features").transform(rows)
    return predictions(C.NaiveBayes(smoothing=1.0, modelType="bernoulli").fit(df), df, "o_orderkey")


@query("mo09_decision_tree")
def _(t):
    return predictions(C.DecisionTreeClassifier(maxDepth=5, seed=1).fit(digits(t)), digits(t))


@query("mo09_regression_tree")
def _(t):
    df = regression_rows(t)
    model = R.DecisionTreeRegressor(maxDepth=4, seed=1).fit(df)
    return model.transform(df).groupBy(F.round("prediction", 6).alias("leaf")).agg(F.count("*").alias("n"), F.avg("label").alias("mean"))


@query("mo10_random_forest")
def _(t):
    return predictions(C.RandomForestClassifier(numTrees=10, maxDepth=5, seed=1).fit(digits(t)), digits(t))


@query("mo11_gradient_boosted_trees")
def _(t):
    return predictions(C.GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(halves(t)), halves(t))


@query("mo11_boosted_regression")
def _(t):
    """Regression by squared and by absolute loss: mean error of either."""
    rows = t.lineitem.select(*FEATURES, (F.col("l_extendedprice") / 1000).cast("double").alias("label"))
    models = boosting.boosted(rows, "label", FEATURES, ["squared", "absolute"], rounds=5, depth=3)
    errors = rows.agg(F.count("*").alias("n"), *[F.avg(F.abs(p - F.col("label"))).alias(loss) for loss, p in models.items()])
    return errors.select(F.explode(F.array(*[F.struct(F.lit(loss).alias("loss"), "n", F.col(loss).alias("error")) for loss in models])).alias("e")).select("e.*")


@query("mo12_impurity", """
    WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
    p AS (SELECT o_orderstatus, n, n / sum(n) OVER (PARTITION BY o_orderstatus) AS p FROM c)
    SELECT o_orderstatus, sum(n)::BIGINT AS total, round(1 - sum(p * p), 9) AS gini, round(-sum(p * log2(p)), 9) AS entropy FROM p GROUP BY 1""")
def _(t):
    return training.impurities(t.orders, "o_orderstatus", "o_orderpriority").select(
        "o_orderstatus", "total", F.round("gini", 9).alias("gini"), F.round("entropy", 9).alias("entropy"))


@query("mo12_variance_impurity", "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS impurity FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.var_pop("l_quantity"), 6).alias("impurity"))


@query("mo13_multilayer_perceptron")
def _(t):
    return predictions(C.MultilayerPerceptronClassifier(layers=[64, 16, 10], maxIter=20, seed=1).fit(digits(t)), digits(t))


@query("mo14_one_vs_rest")
def _(t):
    return predictions(C.OneVsRest(classifier=C.LogisticRegression(maxIter=5)).fit(digits(t)), digits(t))


@query("mo15_isotonic_regression")
def _(t):
    rows = t.lineitem.groupBy(F.col("l_quantity").alias("features")).agg(F.avg("l_extendedprice").alias("label"), F.count("*").cast("double").alias("w"))
    model = R.IsotonicRegression(weightCol="w").fit(rows)
    return model.transform(rows).select("features", "label", "prediction")


@query("mo16_survival_regression")
def _(t):
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("label"), (F.col("o_orderstatus") != "O").cast("double").alias("censor"), F.col("o_custkey").cast("double").alias("c"))
    df = VectorAssembler(inputCols=["c"], outputCol="features").transform(rows)
    return coefficients(t, R.AFTSurvivalRegression(maxIter=10).fit(df), ["o_custkey"])


@query("mo17_k_means")
def _(t):
    model = K.KMeans(k=8, seed=1, maxIter=10, initMode="k-means||").fit(digits(t))
    return model.transform(digits(t)).select("vec_id", "prediction")


@query("mo17_k_means_random")
def _(t):
    return K.KMeans(k=8, seed=1, maxIter=10, initMode="random").fit(digits(t)).transform(digits(t)).select("vec_id", "prediction")


@query("mo18_bisecting_k_means")
def _(t):
    return K.BisectingKMeans(k=6, seed=1, maxIter=10).fit(digits(t)).transform(digits(t)).select("vec_id", "prediction")


@query("mo19_gaussian_mixture")
def _(t):
    rows = t.customer.select("c_custkey", "c_acctbal", "c_nationkey")
    df = VectorAssembler(inputCols=["c_acctbal", "c_nationkey"], outputCol="features").transform(rows)
    done = K.GaussianMixture(k=3, seed=1, maxIter=10).fit(df).transform(df)
    return done.select("c_custkey", "prediction", F.array_max(vector_to_array("probability")).alias("p"))


@query("mo20_lda")
def _(t):
    from pyspark.ml.feature import RegexTokenizer

    cut = RegexTokenizer(inputCol="text", outputCol="words", pattern="[a-z]+", gaps=False, minTokenLength=3).transform(t.documents)
    words = stored(cut.select("doc_id", "words"), "words")  # the vocabulary takes two passes, counting another one
    counted = stored(all_words(words, "words", "features").transform(words).select("doc_id", "features"), "counted")
    model = K.LDA(k=4, maxIter=3, seed=1, optimizer="online").fit(counted)
    done = model.transform(counted)
    return done.select("doc_id", F.array_position(vector_to_array("topicDistribution"), F.array_max(vector_to_array("topicDistribution"))).alias("topic"))


@query("mo21_power_iteration_clustering")
def _(t):
    affinity = t.orders.join(t.lineitem, F.expr("l_orderkey = o_orderkey")).groupBy(
        F.col("l_suppkey").alias("src"), (F.col("o_custkey") + 1_000_000_000).alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    # in every round a vertex goes to all partitions that have an edge of it, so a customer's edges lie in one
    return K.PowerIterationClustering(k=3, maxIter=5, weightCol="weight", initMode="degree").assignClusters(affinity.repartition("dst"))


@query("mo22_streaming_k_means")
def _(t):
    first = [[float(x) for x in r.embedding] for r in t.embeddings.orderBy("vec_id").limit(4).collect()]  # k rows
    states = streaming.States(t.spark, scratch(t.spark, "centres"))
    states.start({"centres": first, "weights": [0.0] * len(first)})
    streaming.train(file_stream(t, "embeddings"), states, streaming.k_means_step("embedding", decay=0.9), scratch(t.spark, "train"))
    return states.history().select(F.col("batch").cast("int").alias("batch"), "n", "moved")


def scaled(df):
    return df.select("event_id", (F.col("value") / 100).alias("label"), (F.col("user_id") / 100).alias("u"), (F.hour("ts") / 24).alias("h"))


def trained(t, rows, step):
    """(batch, n, weights) of a streaming regression on two features."""
    states = streaming.States(t.spark, scratch(t.spark, "weights"))
    states.start({"weights": [0.0] * 3})
    streaming.train(rows, states, step, scratch(t.spark, "train"))
    weights = F.from_json("parameters", "weights array<double>")["weights"]
    return states.history().select(F.col("batch").cast("int").alias("batch"), "n", weights.alias("weights"))


@query("mo23_streaming_regression")
def _(t):
    return trained(t, scaled(file_stream(t, "events")), streaming.linear_step("label", ["u", "h"], rate=0.3))


@query("mo23_streaming_logistic")
def _(t):
    rows = scaled(file_stream(t, "events")).withColumn("label", (F.col("label") > 0.35).cast("double"))
    return trained(t, rows, streaming.linear_step("label", ["u", "h"], rate=0.5, logistic=True))


@query("mo23_predict_on", "SELECT event_id, round(value / 100, 9) AS label, true AS predicted FROM events")
def _(t):
    """Every event predicted by the model as it was before the event's batch."""
    states = streaming.States(t.spark, scratch(t.spark, "weights"))
    states.start({"weights": [0.0] * 3})
    found = streaming.predict_on(
        scaled(file_stream(t, "events")), states, streaming.linear_step("label", ["u", "h"], rate=0.3), scratch(t.spark, "train"), scratch(t.spark, "predicted"),
        "event_id", "label", ["u", "h"])
    return found.select("event_id", F.round("label", 9).alias("label"), F.col("prediction").isNotNull().alias("predicted"))


def ratings(t):
    joined = t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey"))
    return joined.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(
        (F.avg("l_quantity") / 10).alias("rating"))


def blocks(rows):
    """Blocks of users and of items: a task holds a whole one, so there are as many as the ratings need."""
    n = max(LEAST_BLOCKS, -(-rows.count() // RATINGS_PER_BLOCK))
    return {"numUserBlocks": n, "numItemBlocks": n}


@query("mo24_als")
def _(t):
    rows = stored(ratings(t), "ratings")  # read by the training and again by the predictions
    model = recommendation.ALS(rank=4, maxIter=3, regParam=0.1, nonnegative=True, seed=1, userCol="user", itemCol="item", ratingCol="rating", **blocks(rows)).fit(rows)
    return model.transform(rows)


@query("mo24_als_implicit")
def _(t):
    rows = stored(ratings(t), "ratings")  # counted, then trained on
    model = recommendation.ALS(rank=4, maxIter=3, implicitPrefs=True, alpha=2.0, seed=1, userCol="user", itemCol="item", ratingCol="rating", **blocks(rows)).fit(rows)
    return recommend.best_items(model.userFactors, model.itemFactors, 3)  # as recommendForAllUsers, which scores all pairs


BASKETS = "(SELECT DISTINCT o_custkey AS b, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) * 10 + ascii(o_orderstatus) % 10 AS i FROM orders)"


def baskets(t):
    item = F.substring("o_orderpriority", 1, 1).cast("int") * 10 + F.ascii("o_orderstatus") % 10
    return t.orders.select(F.col("o_custkey").alias("b"), item.alias("i"))


@query("mo25_fp_growth", f"""
    SELECT x.i AS a, y.i AS b, count(*) AS n FROM {BASKETS} AS x JOIN {BASKETS} AS y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2
    HAVING count(*) >= 0.2 * (SELECT count(DISTINCT b) FROM {BASKETS})""")
def _(t):
    return training.frequent_pairs(baskets(t), "b", "i", 0.2)


@query("mo25_fp_growth_itemsets")
def _(t):
    """Frequent sets of all sizes."""
    return training.frequent_itemsets(baskets(t), "b", "i", 0.2)


@query("mo26_association_rules", f"""
    WITH s AS (SELECT i, count(*) AS n FROM {BASKETS} GROUP BY 1),
    p AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM {BASKETS} AS x JOIN {BASKETS} AS y ON x.b = y.b AND x.i <> y.i GROUP BY 1, 2)
    SELECT a, b, round(p.n / s.n, 9) AS confidence FROM p JOIN s ON s.i = a WHERE p.n >= 0.2 * (SELECT count(DISTINCT b) FROM {BASKETS}) AND p.n / s.n >= 0.5""")
def _(t):
    items = baskets(t).distinct()
    single = items.groupBy(F.col("i").alias("a")).agg(F.count("*").alias("one"))
    pairs = training.frequent_pairs(items, "b", "i", 0.2)
    both = pairs.union(pairs.select("b", "a", "n"))
    return both.join(single, "a").select("a", "b", F.round(F.col("n") / F.col("one"), 9).alias("confidence")).where("confidence >= 0.5")


@query("mo26_association_rules_itemsets")
def _(t):
    """Rules of frequent sets of all sizes."""
    return training.rules(training.frequent_itemsets(baskets(t), "b", "i", 0.2), 0.5)


@query("mo26_association_rules_model")
def _(t):
    lists = baskets(t).groupBy("b").agg(F.collect_set("i").alias("items"))
    return fpm.FPGrowth(itemsCol="items", minSupport=0.2, minConfidence=0.6).fit(lists).associationRules


@query("mo27_prefix_span")
def _(t):
    day = F.to_date("ts")
    steps = t.events.groupBy("user_id", day.alias("day")).agg(F.collect_set("event_type").alias("types"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("day", "types"))), lambda s: s["types"])
    # a sequence is one user's week: at most seven steps of at most five types
    sequences = steps.groupBy("user_id", F.date_trunc("week", "day")).agg(ordered.alias("sequence"))
    return fpm.PrefixSpan(minSupport=0.1, maxPatternLength=2, sequenceCol="sequence").findFrequentSequentialPatterns(sequences)


# one sequence per user; an item is a type of event in a band of two hours
STEPS = """(SELECT user_id, event_type || '-' || CAST(floor(date_part('hour', ts) / 2) AS BIGINT) AS item,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""


def user_steps(t):
    """(user_id, ts and event_id as step, item): whole sequences, in order of time."""
    band = F.floor(F.hour("ts") / 2).cast("string")
    return t.events_ts.select("user_id", F.struct("ts", "event_id").alias("step"), F.concat_ws("-", "event_type", band).alias("item"))


def flat(patterns):
    """Patterns as text: items of an element joined by +, elements by a blank."""
    return patterns.select(F.array_join(F.transform("pattern", lambda e: F.array_join(e, "+")), " ").alias("pattern"), "n")


@query("mo27_prefix_span_whole")
def _(t):
    """Patterns of up to ten items in whole sequences of users."""
    return flat(patterns.sequential_patterns(user_steps(t), "user_id", "step", "item", 0.2))


@query("mo27_prefix_span_pairs", f"""
    WITH s AS {STEPS}, least AS (SELECT 0.2 * count(DISTINCT user_id) AS n FROM s)
    SELECT item AS pattern, count(DISTINCT user_id) AS n FROM s GROUP BY 1 HAVING count(DISTINCT user_id) >= (SELECT n FROM least)
    UNION ALL SELECT x.item || ' ' || y.item, count(DISTINCT x.user_id) FROM s AS x JOIN s AS y ON x.user_id = y.user_id AND x.pos < y.pos
    GROUP BY x.item, y.item HAVING count(DISTINCT x.user_id) >= (SELECT n FROM least)""")
def _(t):
    return flat(patterns.sequential_patterns(user_steps(t), "user_id", "step", "item", 0.2, max_length=2))


@query("mo28_cross_validation")
def _(t):
    lr = C.LogisticRegression(maxIter=5)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.1]).build()
    found = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(), numFolds=3, seed=1, parallelism=2).fit(digits(t))
    return t.spark.createDataFrame([(p[lr.regParam], float(m)) for p, m in zip(grid, found.avgMetrics)], "reg double, f1 double")


@query("mo28_train_validation_split")
def _(t):
    lr = R.LinearRegression(maxIter=5)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 1.0]).build()
    found = TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(), trainRatio=0.8, seed=1).fit(regression_rows(t))
    return t.spark.createDataFrame([(p[lr.regParam], float(m)) for p, m in zip(grid, found.validationMetrics)], "reg double, rmse double")


@query("mo29_gradient_descent")
def _(t):
    rows = t.lineitem.select((F.col("l_extendedprice") > 50000).cast("double").alias("y"), (F.col("l_quantity") / 50).alias("q"), "l_discount")
    weights, sizes = training.logistic_gradient_descent(rows, "y", ["q", "l_discount"], rounds=10, step=1.0)
    return t.spark.createDataFrame([(i, s, [float(w) for w in weights]) for i, s in enumerate(sizes)], "round int, gradient double, weights array<double>")
