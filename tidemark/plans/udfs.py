"""User-defined functions, aggregates and table functions."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidemark.operators.pieces import with_pieces
from tidemark.registry import query


@query("ud01_scalar_udf", """
    SELECT length(p_name) % 5 AS bucket, count(*) AS n FROM part WHERE length(p_name) > 8 GROUP BY 1 HAVING count(*) % 2 >= 0""")
def _(t):
    """One function in select, where and group by; Arrow batches, not rows."""
    @F.pandas_udf("bigint")
    def chars(s: pd.Series) -> pd.Series:
        return s.str.len()

    kept = t.part.where(chars("p_name") > 8)
    return kept.groupBy((chars("p_name") % 5).alias("bucket")).agg(F.count("*").alias("n")).where("n % 2 >= 0")


@query("ud02_complex_types", "SELECT p_partkey, p_brand || p_size AS text, len(string_split(p_name, ' ')) AS words FROM part")
def _(t):
    @F.pandas_udf("text string, words bigint")
    def describe(s: pd.DataFrame, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": s["b"] + s["n"].astype(str), "words": names.map(len)})

    made = t.part.select("p_partkey", describe(F.struct(F.col("p_brand").alias("b"), F.col("p_size").alias("n")), F.split("p_name", " ")).alias("d"))
    return made.select("p_partkey", "d.text", "d.words")


@query("ud03_batch_udf", "SELECT o_orderkey, round(o_totalprice * 1.1, 3) AS v FROM orders")
def _(t):
    @F.pandas_udf("double")
    def raised(price: pd.Series) -> pd.Series:
        return price * 1.1

    return t.orders.select("o_orderkey", F.round(raised("o_totalprice"), 3).alias("v"))


@query("ud04_udf_over_aggregates", "SELECT o_custkey, round(sum(o_totalprice) / 1000, 7) AS v FROM orders GROUP BY 1")
def _(t):
    @F.pandas_udf("double")
    def thousands(total: pd.Series) -> pd.Series:
        return total / 1000

    return t.orders.groupBy("o_custkey").agg(F.round(thousands(F.sum("o_totalprice")), 7).alias("v"))


@query("ud05_aggregate_function", "SELECT o_custkey, round(exp(avg(ln(o_totalprice))), 3) AS geometric FROM orders GROUP BY 1")
def _(t):
    """Initialize, update, merge and evaluate on Arrow batches with a buffer per group.

    Partials are made per partition before the shuffle, so a hot group moves one row per task.
    """
    def update(batches):
        for b in batches:
            d = b.to_pandas()
            logs = np.log(d["x"])
            g = logs.groupby(d["k"]).agg(["sum", "count"]).reset_index()
            yield pa.RecordBatch.from_arrays(
                [pa.array(g["k"], pa.int64()), pa.array(g["sum"], pa.float64()), pa.array(g["count"], pa.int64())], names=["k", "s", "n"])

    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("x"))
    buffers = rows.mapInArrow(update, "k bigint, s double, n bigint")
    return buffers.groupBy(F.col("k").alias("o_custkey")).agg(F.round(F.exp(F.sum("s") / F.sum("n")), 3).alias("geometric"))


@query("ud05_grouped_aggregate", "SELECT o_custkey, round(max(o_totalprice) - avg(o_totalprice), 6) AS v FROM orders GROUP BY 1")
def _(t):
    """Grouped-aggregate functions on pieces of bounded size; the pieces merge by max and sum."""
    @F.pandas_udf("double")
    def largest(x: pd.Series) -> float:
        return float(x.max())

    @F.pandas_udf("double")
    def total(x: pd.Series) -> float:
        return float(x.sum())

    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    pieces = with_pieces(rows, "o_custkey", F.xxhash64("o_orderkey"))
    parts = pieces.groupBy("o_custkey", "piece").agg(largest("o_totalprice").alias("m"), total("o_totalprice").alias("s"))
    counts = pieces.groupBy("o_custkey").agg(F.count("*").alias("n"))
    merged = parts.groupBy("o_custkey").agg(F.max("m").alias("m"), F.sum("s").alias("s"))
    return merged.join(counts, "o_custkey").select("o_custkey", F.round(F.col("m") - F.col("s") / F.col("n"), 6).alias("v"))


@query("ud06_typed_aggregator", """
    SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY 1""")
def _(t):
    """Zero, reduce and merge are sums; finish is an expression on them."""
    buffers = t.lineitem.groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice") * F.col("l_quantity")).alias("a"), F.sum("l_quantity").alias("b"))
    return buffers.select("l_suppkey", F.round(F.col("a") / F.col("b"), 6).alias("weighted"))


@query("ud07_table_function", "SELECT p_partkey, word, n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), LATERAL (SELECT length(word) AS n)")
def _(t):
    @F.udtf(returnType="word string, n bigint")
    class SplitWords:
        def eval(self, text: str):
            for word in text.split(" "):
                yield word, len(word)

    name = f"split_words_{uuid.uuid4().hex}"
    t.spark.udtf.register(name, SplitWords)
    return t.sql(f"SELECT p_partkey, word, n FROM part, LATERAL {name}(p_name)")


@query("ud08_partition_map", "SELECT c_custkey, c_acctbal < 0 AS owes FROM customer")
def _(t):
    def owes(batches):
        for pdf in batches:
            yield pd.DataFrame({"c_custkey": pdf["c_custkey"], "owes": pdf["c_acctbal"] < 0})

    return t.customer.select("c_custkey", "c_acctbal").mapInPandas(owes, "c_custkey bigint, owes boolean")


@query("ud09_user_types", "SELECT vec_id, len(embedding)::INTEGER AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def _(t):
    vectors = t.embeddings.select("vec_id", array_to_vector("embedding").alias("v"))
    back = vectors.select("vec_id", vector_to_array("v").alias("a"))
    return back.select(
        "vec_id", F.size("a").alias("size"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("ud10_sql_macro", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def _(t):
    t.spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tidemark_charge(price DOUBLE, discount DOUBLE, tax DOUBLE)"
        " RETURNS DOUBLE RETURN price * (1 - discount) * (1 + tax)")
    return t.sql("""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(tidemark_charge(l_extendedprice, l_discount, l_tax), 6) AS charge FROM lineitem""")
