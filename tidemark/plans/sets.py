"""Set operations and missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sampling
from tidemark.registry import query


@query("se01_union_all", "SELECT n_nationkey AS k, CAST(n_regionkey AS DOUBLE) AS v FROM nation UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    return a.union(t.supplier.select("s_suppkey", "s_acctbal"))  # int widens to bigint and double


@query("se02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


def priority(t, status):
    return t.orders.where(F.col("o_orderstatus") == status).select("o_custkey", "o_orderpriority")


def part_sql(status):
    return f"SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = '{status}'"


@query("se03_intersect", f"{part_sql('F')} INTERSECT {part_sql('O')}")
def _(t):
    return priority(t, "F").intersect(priority(t, "O"))


@query("se04_except", f"{part_sql('F')} EXCEPT {part_sql('O')}")
def _(t):
    return priority(t, "F").subtract(priority(t, "O"))


@query("se05_union_many", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
def _(t):
    parts = [t.customer.select("c_name"), t.supplier.select("s_name"), t.nation.select("n_name"), t.region.select("r_name")]
    return reduce(DataFrame.union, parts).toDF("name")


HOLES = "SELECT c_custkey, nullif(c_nationkey % 4, 0) AS a, nullif(c_mktsegment, 'BUILDING') AS b, CASE WHEN c_acctbal < 2000 THEN NULL ELSE c_acctbal END AS d FROM customer"


def holes(t):
    return t.customer.select(
        "c_custkey", F.expr("nullif(c_nationkey % 4, 0) as a"), F.expr("nullif(c_mktsegment, 'BUILDING') as b"),
        F.expr("if(c_acctbal < 2000, null, c_acctbal) as d"))


@query("se07_drop_nulls", f"""
    SELECT 'any' AS how, * FROM ({HOLES}) WHERE a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL
    UNION ALL SELECT 'all', * FROM ({HOLES}) WHERE a IS NOT NULL OR b IS NOT NULL OR d IS NOT NULL
    UNION ALL SELECT 'two', * FROM ({HOLES}) WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (d IS NOT NULL)::INT >= 2""")
def _(t):
    df, cols = holes(t), ["a", "b", "d"]
    kinds = {"any": df.na.drop("any", subset=cols), "all": df.na.drop("all", subset=cols), "two": df.na.drop(thresh=2, subset=cols)}
    return reduce(DataFrame.union, [v.select(F.lit(k).alias("how"), *df.columns) for k, v in kinds.items()])


@query("se08_fill_nulls", f"SELECT c_custkey, coalesce(a, -1) AS a, coalesce(b, 'none') AS b, coalesce(d, 0.5) AS d FROM ({HOLES})")
def _(t):
    return holes(t).na.fill({"a": -1, "b": "none", "d": 0.5})


@query("se09_replace_values", """
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS c_mktsegment,
           CASE c_nationkey WHEN 3 THEN 300 ELSE c_nationkey END AS c_nationkey FROM customer""")
def _(t):
    df = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    return df.na.replace({"BUILDING": "B", "MACHINERY": "M"}, subset=["c_mktsegment"]).na.replace(3, 300, subset=["c_nationkey"])


@query("se10_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("se11_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 4000")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.where("s_acctbal > 4000").select("s_nationkey"))


@query("se12_subtract_keeps_copies", """
    SELECT o_custkey, o_orderpriority FROM orders AS o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders AS i
        WHERE i.o_orderstatus = 'O' AND i.o_custkey = o.o_custkey AND i.o_orderpriority = o.o_orderpriority)""")
def _(t):
    return priority(t, "F").join(priority(t, "O"), ["o_custkey", "o_orderpriority"], "left_anti")


@query("se13_sort_by_function", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey % 10 DESC, c_custkey")
def _(t):
    return t.customer.select("c_custkey", "c_name").orderBy((F.col("c_custkey") % 10).desc(), "c_custkey")


@query("se14_random_split")
def _(t):
    train, test = sampling.split(t.customer, ["c_custkey"], [0.8, 0.2], seed=2)
    return train.agg(F.lit("train").alias("part"), F.count("*").alias("n")).union(test.agg(F.lit("test"), F.count("*")))


@query("se15_join_with", """
    SELECT n_name AS left_name, r_name AS right_name, n_nationkey AS left_key FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    a = t.nation.select(F.struct("*").alias("a"))
    b = t.region.select(F.struct("*").alias("b"))
    pairs = a.join(b, F.col("a.n_regionkey") == F.col("b.r_regionkey"))
    return pairs.select(
        F.col("a.n_name").alias("left_name"), F.col("b.r_name").alias("right_name"), F.col("a.n_nationkey").alias("left_key"))
