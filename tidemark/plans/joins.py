"""Joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.ranges import point_in_range
from tidemark.operators.skew import broadcast_checked, skew_join
from tidemark.operators import neighbours
from tidemark.registry import query, same
from tidemark.streaming.runner import file_stream, run_append


def rich(t):
    return t.customer.where("c_acctbal > 5000")


def big(t):
    return t.orders.where("o_totalprice > 300000")


RICH = "(SELECT * FROM customer WHERE c_acctbal > 5000)"
BIG = "(SELECT * FROM orders WHERE o_totalprice > 300000)"
ON = "c_custkey = o_custkey"

for _id, _how, _word in [
    ("jo01_inner", "inner", "JOIN"), ("jo02_left_outer", "left", "LEFT JOIN"),
    ("jo03_right_outer", "right", "RIGHT JOIN"), ("jo04_full_outer", "full", "FULL JOIN"),
]:
    @query(_id, f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM {RICH} AS c {_word} {BIG} AS o ON {ON}")
    def _(t, how=_how):
        return rich(t).join(big(t), F.expr(ON), how).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("jo05_left_semi", f"SELECT c_custkey, c_name FROM {RICH} AS c WHERE EXISTS (SELECT 1 FROM {BIG} AS o WHERE {ON})")
def _(t):
    return rich(t).join(big(t), F.expr(ON), "left_semi").select("c_custkey", "c_name")


@query("jo06_left_anti", f"SELECT c_custkey, c_name FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM {BIG} AS o WHERE {ON})")
def _(t):
    return t.customer.join(big(t), F.expr(ON), "left_anti").select("c_custkey", "c_name")


@query("jo07_cross", "SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def _(t):
    # the operator itself; one side is a dimension whose size is checked first
    regions = broadcast_checked(t.region.select("r_name"), 1000)
    return t.supplier.select("s_suppkey").crossJoin(regions)


same("jo08_natural", """
    SELECT n_name, r_name, n_regionkey FROM (SELECT n_name, n_regionkey FROM nation) AS a
    NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) AS b""")
same("jo08_natural_left", """
    SELECT n_name, supplier_name FROM (SELECT n_nationkey AS k, n_name FROM nation) AS a
    NATURAL LEFT JOIN (SELECT s_nationkey AS k, s_name AS supplier_name FROM supplier WHERE s_acctbal > 5000) AS b""")


@query("jo09_using", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) FULL JOIN (SELECT s_nationkey AS k, s_name FROM supplier WHERE s_acctbal < 3000) USING (k)")
def _(t):
    nations = t.nation.select(F.col("n_nationkey").alias("k"), "n_name")
    sellers = t.supplier.where("s_acctbal < 3000").select(F.col("s_nationkey").alias("k"), "s_name")
    return nations.join(sellers, on=["k"], how="full")


same("jo10_existence", """
    SELECT c_custkey, c_acctbal FROM customer
    WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)""")


@query("jo11_range", """
    SELECT a.event_id AS purchase, e.event_id, e.event_type FROM events AS a
    JOIN events AS e ON e.value >= a.value * 10 AND e.value < a.value * 10 + 0.02 WHERE a.event_type = 'purchase'""")
def _(t):
    ranges = t.events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase"), (F.col("value") * 10).alias("low"),
        (F.col("value") * 10 + 0.02).alias("high"),
    )
    points = t.events.select("event_id", "event_type", "value")
    pairs = point_in_range(points, ranges, F.col("value"), F.col("low"), F.col("high"), 0.02)
    return pairs.select("purchase", "event_id", "event_type")


@query("jo12_broadcast_hint", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    nations = broadcast_checked(t.nation, 10_000)
    return t.customer.join(nations, F.expr("c_nationkey = n_nationkey")).groupBy("n_name").agg(
        F.count("*").alias("customers")
    )


LINES = """SELECT o_orderpriority, count(*) AS lines, round(sum(l_extendedprice), 2) AS price
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""

for _id, _hint in [("jo13_shuffled_hash", "shuffle_hash"), ("jo14_sort_merge", "merge")]:
    @query(_id, LINES)
    def _(t, hint=_hint):
        joined = t.lineitem.join(t.orders.hint(hint), F.expr("o_orderkey = l_orderkey"))
        return joined.groupBy("o_orderpriority").agg(
            F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price")
        )


@query("jo15_null_safe", """
    SELECT s_suppkey, n_nationkey FROM (SELECT s_suppkey, nullif(s_nationkey % 7, 0) AS k FROM supplier) AS s
    JOIN (SELECT n_nationkey, nullif(n_nationkey % 7, 0) AS k FROM nation) AS n ON s.k IS NOT DISTINCT FROM n.k""")
def _(t):
    s = t.supplier.select("s_suppkey", F.expr("nullif(s_nationkey % 7, 0) as k"))
    n = t.nation.select("n_nationkey", F.expr("nullif(n_nationkey % 7, 0) as k2"))
    return s.join(n, s.k.eqNullSafe(n.k2)).select("s_suppkey", "n_nationkey")


@query("jo16_skewed", """
    WITH f AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_suppkey END AS k FROM lineitem)
    SELECT s_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM f JOIN supplier ON k = s_suppkey GROUP BY 1""")
def _(t):
    # a third of the lines share one key
    key = F.when(F.col("l_partkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey")).alias("k")
    lines = t.lineitem.select(key, "l_orderkey", "l_linenumber", "l_extendedprice")
    sellers = t.supplier.select(F.col("s_suppkey").alias("k"), "s_name")
    joined = skew_join(lines, sellers, "k", row=F.xxhash64("l_orderkey", "l_linenumber"))
    return joined.groupBy("s_name").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


same("jo17_star", """
    SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS price
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE p_size < 20 GROUP BY r_name, p_brand""")


@query("jo18_self", """
    SELECT a.n_name AS name, b.n_name AS neighbour FROM nation AS a JOIN nation AS b
    ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def _(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(
        b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    ).select(F.col("a.n_name").alias("name"), F.col("b.n_name").alias("neighbour"))


@query("jo19_cogroup", """
    SELECT k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers,
           round(coalesce(owed, 0) - coalesce(due, 0), 2) AS balance
    FROM (SELECT c_nationkey AS k, count(*) AS customers, sum(c_acctbal) AS owed FROM customer GROUP BY 1)
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers, sum(s_acctbal) AS due FROM supplier GROUP BY 1) USING (k)""")
def _(t):
    # both sides are aggregated before the groups meet, so no group is held in one task
    left = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(
        F.count("*").alias("customers"), F.sum("c_acctbal").alias("owed"))
    right = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(
        F.count("*").alias("suppliers"), F.sum("s_acctbal").alias("due"))
    zero = F.lit(0)
    return left.join(right, "k", "full").select(
        "k", F.coalesce("customers", zero).alias("customers"), F.coalesce("suppliers", zero).alias("suppliers"),
        F.round(F.coalesce("owed", zero) - F.coalesce("due", zero), 2).alias("balance"),
    )


@query("jo19_cogroup_function", """
    SELECT k, c_name AS name, coalesce(n, 0) AS orders FROM (SELECT c_custkey AS k, c_name FROM customer)
    LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) USING (k)""")
def _(t):
    """Any Python function on matching groups; right for keys with a bounded number of rows."""
    def both(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "name": [left["c_name"].iloc[0]], "orders": [int(right["n"].sum())]})

    left = t.customer.select(F.col("c_custkey").alias("k"), "c_name")
    right = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return left.groupBy("k").cogroup(right.groupBy("k")).applyInPandas(both, "k bigint, name string, orders bigint")


@query("jo20_keyed_joins", """
    SELECT c_custkey AS k, c_mktsegment AS left_value, o_orderstatus AS right_value, 'inner' AS kind
        FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT c_custkey, c_mktsegment, o_orderstatus, 'left'
        FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey""")
def _(t):
    left = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("left_value"))
    right = t.orders.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("right_value"))
    return left.join(right, "k").withColumn("kind", F.lit("inner")).union(
        left.join(right, "k", "left").withColumn("kind", F.lit("left"))
    )


@query("jo21_subtract_by_key", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    large = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(large, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("jo22_cartesian", "SELECT n_name, r_name, n_regionkey = r_regionkey AS matches FROM nation, region")
def _(t):
    regions = broadcast_checked(t.region, 1000)
    return t.nation.crossJoin(regions).select(
        "n_name", "r_name", (F.col("n_regionkey") == F.col("r_regionkey")).alias("matches")
    )


@query("jo23_similarity")
def _(t):
    """Pairs of near vectors: candidates share a random-projection bucket, then exact distance.
    Equal vectors are joined as one row, so copies do not pair up with one another."""
    distinct = t.embeddings.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    found = neighbours.near_pairs(distinct, "vec_id", "embedding", 1.1, recall=0.97)
    copies = distinct.select("vec_id", "copies")
    return found.join(copies.toDF("a", "copies_a"), "a").join(copies.toDF("b", "copies_b"), "b").select(
        "a", "b", (F.col("copies_a") * F.col("copies_b")).alias("pairs"), F.round("distance", 6).alias("distance"))


@query("jo24_stream_static", """
    SELECT event_id, user_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'""")
def _(t):
    buyers = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    joined = file_stream(t, "events").where("event_type = 'purchase'").join(buyers, "user_id")
    return run_append(joined.select("event_id", "user_id", "c_name"))
