"""Feature transformers."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, feature as M
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.ml.text import all_words, term_counts, tf_idf
from tidemark.operators import near_sets, neighbours
from tidemark.registry import query
from tidemark.session import scratch, stored


def pairs(t, inputs=("c_acctbal", "c_nationkey")):
    rows = t.customer.select("c_custkey", *[F.col(c).cast("double") for c in inputs])
    return M.VectorAssembler(inputCols=list(inputs), outputCol="v").transform(rows)


def spread(df, key, column, digits=9, n=2):
    a = vector_to_array(column)
    return df.select(key, *[F.round(a[i], digits).alias(f"x{i}") for i in range(n)])


def vectors(t):
    return t.embeddings.select("vec_id", "label", array_to_vector("embedding").alias("v"))


def lines(t):
    return t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")


@query("ft01_binarizer", "SELECT c_custkey, CASE WHEN c_acctbal > 3000 THEN 1.0 ELSE 0.0 END::DOUBLE AS b FROM customer")
def _(t):
    return M.Binarizer(threshold=3000.0, inputCol="c_acctbal", outputCol="b").transform(t.customer).select("c_custkey", "b")


@query("ft02_bucketizer", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 2500 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END::DOUBLE AS b FROM customer""")
def _(t):
    splits = [float("-inf"), 0.0, 2500.0, 5000.0, float("inf")]
    return M.Bucketizer(splits=splits, inputCol="c_acctbal", outputCol="b", handleInvalid="keep").transform(t.customer).select("c_custkey", "b")


@query("ft03_quantile_discretizer")
def _(t):
    model = M.QuantileDiscretizer(numBuckets=5, inputCol="c_acctbal", outputCol="b", relativeError=0.001).fit(t.customer)
    return model.transform(t.customer).groupBy("b").agg(F.count("*").alias("n"))


@query("ft04_standard_scaler", """
    SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 9) AS x0,
           round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER (), 9) AS x1 FROM customer""")
def _(t):
    df = pairs(t)
    return spread(M.StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(df).transform(df), "c_custkey", "s")


@query("ft05_min_max_scaler", """
    SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 2 - 1, 9) AS x0,
           round((c_nationkey - min(c_nationkey) OVER ()) / (max(c_nationkey) OVER () - min(c_nationkey) OVER ()) * 2 - 1, 9)::DOUBLE AS x1 FROM customer""")
def _(t):
    df = pairs(t)
    return spread(M.MinMaxScaler(inputCol="v", outputCol="s", min=-1.0, max=1.0).fit(df).transform(df), "c_custkey", "s")


@query("ft06_max_abs_scaler", "SELECT c_custkey, round(c_acctbal / max(abs(c_acctbal)) OVER (), 9) AS x0, round(c_nationkey / max(abs(c_nationkey)) OVER (), 9) AS x1 FROM customer")
def _(t):
    df = pairs(t)
    return spread(M.MaxAbsScaler(inputCol="v", outputCol="s").fit(df).transform(df), "c_custkey", "s")


@query("ft07_normalizer", "SELECT c_custkey, round(c_acctbal / sqrt(c_acctbal ** 2 + c_nationkey ** 2), 9) AS x0, round(c_nationkey / sqrt(c_acctbal ** 2 + c_nationkey ** 2), 9) AS x1 FROM customer")
def _(t):
    return spread(M.Normalizer(p=2.0, inputCol="v", outputCol="s").transform(pairs(t)), "c_custkey", "s")


@query("ft08_elementwise_product", "SELECT c_custkey, round(c_acctbal * 0.5, 9) AS x0, c_nationkey * 3.0::DOUBLE AS x1 FROM customer")
def _(t):
    product = M.ElementwiseProduct(scalingVec=Vectors.dense(0.5, 3.0), inputCol="v", outputCol="s")
    return spread(product.transform(pairs(t)), "c_custkey", "s")


@query("ft09_polynomial_expansion", """
    SELECT c_custkey, a AS x0, round(a * a, 6) AS x1, b AS x2, round(a * b, 6) AS x3, b * b AS x4 FROM (
        SELECT c_custkey, round(c_acctbal, 6) AS a, c_nationkey::DOUBLE AS b FROM customer)""")
def _(t):
    return spread(M.PolynomialExpansion(degree=2, inputCol="v", outputCol="s").transform(pairs(t)), "c_custkey", "s", 6, 5)


@query("ft10_interaction", "SELECT c_custkey, round(c_acctbal * c_nationkey, 6) AS x0, c_nationkey::DOUBLE * c_nationkey AS x1 FROM customer")
def _(t):
    both = M.Interaction(inputCols=["c_nationkey", "v"], outputCol="s").transform(pairs(t))
    return spread(both, "c_custkey", "s", 6)


@query("ft11_dct", """
    WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings),
    f AS (SELECT unnest(range(64)) AS k)
    SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(x * cos(pi() / 64 * (n + 0.5) * k)) * sqrt(2.0 / 64) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END, 6) AS c
    FROM x, f GROUP BY vec_id, k""")
def _(t):
    done = M.DCT(inverse=False, inputCol="v", outputCol="c").transform(vectors(t))
    return done.select("vec_id", F.posexplode(vector_to_array("c")).alias("k", "c")).withColumn("c", F.round("c", 6))


@query("ft12_vector_assembler", "SELECT vec_id, 66::INTEGER AS size, label::DOUBLE AS first, round(embedding[1]::DOUBLE, 9) AS second, vec_id::DOUBLE AS last FROM embeddings")
def _(t):
    made = M.VectorAssembler(inputCols=["label", "v", "vec_id"], outputCol="a").transform(vectors(t))
    a = vector_to_array("a")
    return made.select("vec_id", F.size(a).alias("size"), a[0].alias("first"), F.round(a[1], 9).alias("second"), a[65].alias("last"))


@query("ft13_vector_slicer", "SELECT vec_id, round(embedding[11]::DOUBLE, 9) AS x0, round(embedding[1]::DOUBLE, 9) AS x1 FROM embeddings")
def _(t):
    return spread(M.VectorSlicer(inputCol="v", outputCol="s", indices=[10, 0]).transform(vectors(t)), "vec_id", "s")


@query("ft14_vector_indexer")
def _(t):
    df = pairs(t)
    model = M.VectorIndexer(inputCol="v", outputCol="s", maxCategories=30).fit(df)
    return spread(model.transform(df), "c_custkey", "s")


@query("ft15_string_indexer", """
    SELECT c_custkey, c_mktsegment, (row_number() OVER (ORDER BY n DESC, c_mktsegment) - 1)::DOUBLE AS i, c_mktsegment AS again FROM (
        SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) JOIN customer USING (c_mktsegment)""".replace(
    "SELECT c_custkey, c_mktsegment, (row_number() OVER (ORDER BY n DESC, c_mktsegment) - 1)::DOUBLE AS i, c_mktsegment AS again FROM (\n        SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)",
    "SELECT c_custkey, c_mktsegment, i, c_mktsegment AS again FROM (SELECT c_mktsegment, (row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1)::DOUBLE AS i FROM customer GROUP BY 1)"))
def _(t):
    model = M.StringIndexer(inputCol="c_mktsegment", outputCol="i", handleInvalid="error").fit(t.customer)
    indexed = model.transform(t.customer)
    return M.IndexToString(inputCol="i", outputCol="again", labels=model.labels).transform(indexed).select("c_custkey", "c_mktsegment", "i", "again")


@query("ft16_one_hot", """
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS x0, CASE WHEN p_size % 4 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS x1,
           CASE WHEN p_size % 4 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS x2 FROM part""")
def _(t):
    rows = t.part.select("p_partkey", (F.col("p_size") % 4).cast("double").alias("c"))
    return spread(M.OneHotEncoder(inputCols=["c"], outputCols=["s"], dropLast=True).fit(rows).transform(rows), "p_partkey", "s", n=3)


@query("ft17_tokenizer", "SELECT item_id, regexp_split_to_array(lower(text), '\\s') AS words FROM benchmark")
def _(t):
    return M.Tokenizer(inputCol="text", outputCol="words").transform(t.benchmark).select("item_id", "words")


TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3)"


WORDS_PER_PART = 2_000_000


def tokens(df):
    return M.RegexTokenizer(inputCol="text", outputCol="words", pattern="[a-z]+", gaps=False, minTokenLength=3).transform(df)


@query("ft18_regex_tokenizer", f"SELECT doc_id, {TOKENS} AS words FROM documents")
def _(t):
    return tokens(t.documents).select("doc_id", "words")


@query("ft19_stop_words", f"SELECT doc_id, list_filter({TOKENS}, lambda x: x NOT IN ('the', 'and', 'der', 'die', 'les')) AS kept FROM documents")
def _(t):
    remover = M.StopWordsRemover(inputCol="words", outputCol="kept", stopWords=["the", "and", "der", "die", "les"])
    return remover.transform(tokens(t.documents)).select("doc_id", "kept")


@query("ft20_ngram", """
    WITH w AS (SELECT item_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM (SELECT item_id, regexp_split_to_array(lower(text), '\\s') AS w FROM benchmark))
    SELECT item_id, a || ' ' || b || ' ' || c AS gram, count(*) AS n FROM (
        SELECT item_id, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM w WINDOW s AS (PARTITION BY item_id ORDER BY i)) WHERE c IS NOT NULL GROUP BY 1, 2""")
def _(t):
    words = M.Tokenizer(inputCol="text", outputCol="words").transform(t.benchmark)
    grams = M.NGram(n=3, inputCol="words", outputCol="grams").transform(words)
    return grams.select("item_id", F.explode("grams").alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("ft21_hashing_tf")
def _(t):
    made = M.HashingTF(inputCol="words", outputCol="tf", numFeatures=64).transform(tokens(t.documents))
    return made.select("doc_id", F.size("words").alias("words"), F.aggregate(vector_to_array("tf"), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("ft22_count_vectorizer", "SELECT p_partkey, word, count(*)::DOUBLE AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1, 2")
def _(t):
    words = t.part.select("p_partkey", F.split("p_name", " ").alias("words"))
    model = all_words(words, "words", "tf")
    named = t.spark.createDataFrame(list(enumerate(model.vocabulary)), "i int, word string")
    cells = F.udf(lambda v: list(zip(v.indices.tolist(), v.values.tolist())), "array<struct<i: int, n: double>>")
    long = model.transform(words).select("p_partkey", F.explode(cells("tf")).alias("c")).select("p_partkey", "c.i", "c.n")
    return long.join(named, "i").select("p_partkey", "word", "n")


@query("ft23_idf", f"""
    WITH c AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) GROUP BY 1, 2),
    d AS (SELECT word, count(*) AS df FROM c GROUP BY 1), m AS (SELECT count(DISTINCT doc_id) AS m FROM c)
    SELECT doc_id, word, tf, round(tf * ln((m + 1) / (df + 1)), 6) AS tfidf FROM c JOIN d USING (word), m""")
def _(t):
    # counted once for documents, document frequencies and weights
    terms = stored(term_counts(tokens(t.documents), "doc_id", F.col("words")), "terms")
    return tf_idf(terms, "doc_id").select("doc_id", "word", "tf", F.round("tfidf", 6).alias("tfidf"))


@query("ft23_idf_model")
def _(t):
    hashed = M.HashingTF(inputCol="words", outputCol="tf", numFeatures=256).transform(tokens(t.documents))
    model = M.IDF(inputCol="tf", outputCol="w", minDocFreq=2).fit(hashed)
    return model.transform(hashed).select("doc_id", F.array_max(vector_to_array("w")).alias("largest"))


@query("ft24_word2vec")
def _(t):
    """Each partition trains on its own, so there are as many as the words need."""
    words = stored(tokens(t.documents).select("doc_id", "words"), "words")
    n = words.agg(F.sum(F.size("words"))).first()[0] or 0
    model = M.Word2Vec(vectorSize=8, minCount=5, maxIter=1, seed=3, numPartitions=max(4, -(-n // WORDS_PER_PART)), inputCol="words", outputCol="v").fit(words)
    return spread(model.transform(words), "doc_id", "v", 6, 8)


@query("ft25_pca")
def _(t):
    df = vectors(t)
    return spread(M.PCA(k=3, inputCol="v", outputCol="p").fit(df).transform(df), "vec_id", "p", 6, 3)


@query("ft26_sql_transformer", "SELECT c_custkey, c_acctbal, c_acctbal + c_nationkey AS total FROM customer WHERE c_nationkey > 5")
def _(t):
    step = M.SQLTransformer(statement="SELECT c_custkey, c_acctbal, c_acctbal + c_nationkey AS total FROM __THIS__ WHERE c_nationkey > 5")
    return step.transform(t.customer)


@query("ft27_r_formula")
def _(t):
    df = t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    made = M.RFormula(formula="c_acctbal ~ c_mktsegment + c_nationkey").fit(df).transform(df)
    return made.select("c_custkey", "label", F.array_join(vector_to_array("features").cast("array<string>"), ",").alias("features"))


@query("ft28_feature_selector")
def _(t):
    rows = t.customer.select("c_custkey", F.abs(F.hash("c_mktsegment") % 5).cast("double").alias("label"), "c_nationkey", (F.col("c_custkey") % 3).alias("k"), (F.col("c_acctbal") > 0).cast("int").alias("pos"))
    df = M.VectorAssembler(inputCols=["c_nationkey", "k", "pos"], outputCol="v").transform(rows)
    selector = M.UnivariateFeatureSelector(featuresCol="v", labelCol="label", outputCol="s", selectionMode="numTopFeatures")
    model = selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(2).fit(df)
    return spread(model.transform(df), "c_custkey", "s")


@query("ft28_feature_selector_modes")
def _(t):
    """Features that are kept by a share of all, and by the chance of a false choice."""
    rows = t.customer.select("c_custkey", (F.col("c_nationkey") % 4).cast("double").alias("label"), "c_nationkey", (F.col("c_custkey") % 3).alias("k"), (F.col("c_acctbal") > 0).cast("int").alias("pos"))
    df = M.VectorAssembler(inputCols=["c_nationkey", "k", "pos"], outputCol="v").transform(rows)
    kept = []
    for mode, threshold in (("percentile", 0.67), ("fpr", 0.001), ("fdr", 0.01), ("fwe", 0.01)):
        selector = M.UnivariateFeatureSelector(featuresCol="v", labelCol="label", outputCol="s", selectionMode=mode)
        model = selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(threshold).fit(df)
        kept.append((mode, sorted(int(i) for i in model.selectedFeatures)))
    return t.spark.createDataFrame(kept, "mode string, features array<int>")


@query("ft29_minhash_lsh")
def _(t):
    """Near word sets that share a hash. Equal sets are counted first and joined as one row each,
    so copies of a document do not pair up with one another. The sets are written first: else the
    filter on their size and the hash function, which refuses empty sets, meet in one condition."""
    sets = tokens(t.documents).select("doc_id", F.array_sort(F.array_distinct("words")).alias("words")).where("size(words) > 0")
    distinct = stored(sets.groupBy("words").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "sets")
    hashed = M.HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 18, binary=True).transform(distinct)
    model = M.MinHashLSH(inputCol="tf", outputCol="h", numHashTables=3, seed=5).fit(hashed)
    indices = F.udf(lambda v: v.indices.tolist(), "array<int>")
    values = F.udf(lambda hs: [float(h[0]) for h in hs], "array<double>")
    marked = model.transform(hashed).select("doc_id", "copies", indices("tf").alias("members"), values("h").alias("hashes"))
    rows = stored(marked.withColumn("row", F.monotonically_increasing_id()), "hashed")
    found = near_sets.hash_sharing_pairs(rows, "row", "members", "hashes", "doc_id", 0.2)
    names = rows.select("row", "doc_id", "copies")
    return found.withColumnsRenamed({"a": "_a", "b": "_b"}).join(names.toDF("_a", "a", "a_copies"), "_a").join(names.toDF("_b", "b", "b_copies"), "_b").select(
        "a", "a_copies", "b", "b_copies", "distance")


@query("ft30_random_projection_lsh")
def _(t):
    asked = t.spark.range(1).select("id", F.array_repeat(F.lit(0.1), 64).alias("v"))
    near = neighbours.nearest(t.embeddings, "vec_id", "embedding", asked, "id", "v", 10, reach=1.1)
    return near.select(F.col("key").alias("vec_id"), "distance")


@query("ft30_nearest_of_rows")
def _(t):
    """The ten nearest vectors of every twentieth one, itself left out."""
    asked = t.embeddings.where("vec_id % 20 = 0")
    near = neighbours.nearest(t.embeddings, "vec_id", "embedding", asked, "vec_id", "embedding", 11, reach=1.2)
    return near.where("query <> key").select("query", "key", "distance", "place")


@query("ft31_pipeline")
def _(t):
    stages = [
        M.RegexTokenizer(inputCol="text", outputCol="words", pattern="[a-z]+", gaps=False, minTokenLength=3),
        M.HashingTF(inputCol="words", outputCol="tf", numFeatures=128), M.IDF(inputCol="tf", outputCol="w")]
    path = scratch(t.spark, "pipeline")
    Pipeline(stages=stages).fit(t.documents).write().overwrite().save(path)
    return PipelineModel.load(path).transform(t.documents).select("doc_id", F.array_max(vector_to_array("w")).alias("largest"))
