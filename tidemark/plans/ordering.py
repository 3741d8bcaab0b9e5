"""Sorting, limits, top-k, samples and partitioning."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import sampling
from tidemark.operators.estimates import estimate
from tidemark.operators.ordering import indexed_partitions, with_index
from tidemark.registry import query, same
from tidemark.session import checkpointed
from tidemark.tables import Tables


@query("so01_global_sort", """
    SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_custkey % 7, 0) DESC NULLS LAST, o_totalprice, o_orderkey) - 1 AS place FROM orders""")
def _(t):
    x = F.expr("nullif(o_custkey % 7, 0)")
    rows = t.orders.select("o_orderkey", x.alias("x"), "o_totalprice")
    return with_index(rows, [F.col("x").desc_nulls_last(), "o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


@query("so01_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


def in_order_within(df, *order):
    """Is each row not smaller than the one before it in its partition?"""
    rows = checkpointed(df).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    before = W.partitionBy("_part").orderBy("_row")
    key = F.struct(*order)
    return rows.withColumn("ok", F.coalesce(F.lag(key).over(before) <= key, F.lit(True)))


@query("so02_sort_within", "SELECT o_custkey, count(*) AS n, true AS ok FROM orders GROUP BY 1")
def _(t):
    placed = t.orders.select("o_custkey", "o_totalprice").repartition(8, "o_custkey").sortWithinPartitions("o_custkey", "o_totalprice")
    return in_order_within(placed, "o_custkey", "o_totalprice").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.bool_and("ok").alias("ok"))


@query("so03_distribute_cluster", "SELECT o_custkey, count(*) AS n, 1::BIGINT AS partitions, true AS ok FROM orders GROUP BY 1")
def _(t):
    placed = t.sql("SELECT o_custkey, o_orderkey FROM orders DISTRIBUTE BY o_custkey SORT BY o_custkey")
    return in_order_within(placed, "o_custkey").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.countDistinct("_part").alias("partitions"), F.bool_and("ok").alias("ok"))


@query("so04_limit", "SELECT least(count(*), 100) AS n, 100::BIGINT AS kept FROM orders WHERE o_totalprice > 1000")
def _(t):
    # which rows a plain limit keeps is not fixed; their number is
    some = t.orders.where("o_totalprice > 1000").limit(100)
    return some.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("kept"))


@query("so05_top_k", "SELECT o_orderkey, round(o_totalprice / 1000, 6) AS thousands FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select(
        "o_orderkey", F.round(F.col("o_totalprice") / 1000, 6).alias("thousands"))


@query("so06_take_ordered", """
    (SELECT 'top' AS kind, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 10)
    UNION ALL (SELECT 'bottom', l_extendedprice FROM lineitem ORDER BY l_extendedprice LIMIT 10)""")
def _(t):
    price = t.lineitem.select("l_extendedprice")
    return price.orderBy(F.desc("l_extendedprice")).limit(10).select(F.lit("top").alias("kind"), "l_extendedprice").union(
        price.orderBy("l_extendedprice").limit(10).select(F.lit("bottom"), "l_extendedprice"))


@query("so07_top_by_key", """
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2""")
def _(t):
    best = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("n", F.row_number().over(best)).where("n <= 2").select("o_custkey", "o_orderkey")


same("so08_order_by_ordinal", "SELECT s_name, s_acctbal FROM supplier ORDER BY 2 DESC, 1 LIMIT 30")


@query("so09_filter_by_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000")
def _(t):
    return t.orders.where(F.col("o_totalprice").between(100000, 110000)).select("o_orderkey", "o_totalprice")


@query("so10_sort_by_key", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) - 1 AS i FROM orders")
def _(t):
    return with_index(t.orders.select("o_custkey", "o_orderkey"), [F.desc("o_custkey"), "o_orderkey"], "i").select("o_orderkey", "i")


@query("so11_bernoulli_sample")
def _(t):
    return sampling.bernoulli(t.orders, ["o_orderkey"], 0.1, seed=5)


@query("so11_poisson_sample")
def _(t):
    """With replacement: a row is drawn 0, 1, 2, ... times, by Spark's Poisson sampler."""
    return t.orders.sample(withReplacement=True, fraction=0.3, seed=5).groupBy("o_orderkey").agg(F.count("*").alias("times"))


@query("so12_stratified_sample")
def _(t):
    drawn = sampling.stratified(t.orders, ["o_orderkey"], "o_orderstatus", {"F": 0.5, "O": 0.1}, seed=3)
    return drawn.select("o_orderkey", "o_orderstatus")


@query("so13_exact_stratified_sample")
def _(t):
    drawn = sampling.stratified_exact(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus", 0.2, seed=3)
    return drawn.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("so14_fixed_size_sample")
def _(t):
    return sampling.fixed_size(t.customer, ["c_custkey"], 100, seed=9)


@query("so15_random_split")
def _(t):
    parts = sampling.split(t.orders.select("o_orderkey"), ["o_orderkey"], [0.7, 0.2, 0.1], seed=11)
    out = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.union(p.withColumn("part", F.lit(i)))
    return out


@query("so16_table_sample")
def _(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(
        "SELECT 'bucket' AS kind, count(*) AS n FROM orders TABLESAMPLE (BUCKET 1 OUT OF 4)"
        " UNION ALL SELECT 'percent', count(*) FROM orders TABLESAMPLE (10 PERCENT)")


@query("so17_repartition_coalesce", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_orderstatus").repartition(12).coalesce(3)


@query("so18_partitioners", "SELECT o_custkey, 1::BIGINT AS hash_partitions, o_custkey % 4 AS custom FROM orders GROUP BY o_custkey")
def _(t):
    """Hash, range and custom placement: a custom partitioner is a hash of a computed column."""
    rows = t.orders.select("o_custkey").withColumn("custom", F.col("o_custkey") % 4)
    placed = rows.repartition(8, "o_custkey").withColumn("_p", F.spark_partition_id())
    return placed.groupBy("o_custkey", "custom").agg(F.countDistinct("_p").alias("hash_partitions"))


@query("so18_range_partitioner")
def _(t):
    placed = checkpointed(t.orders.select("o_totalprice").repartitionByRange(8, "o_totalprice"))
    return placed.groupBy(F.spark_partition_id().alias("partition")).agg(
        F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("so19_zip_with_index", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part")
def _(t):
    return with_index(t.part.select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], "i").select("p_partkey", "i")


@query("so19_zip_with_unique_id", "SELECT count(*) AS rows_, count(*) AS ids, true AS dense FROM lineitem")
def _(t):
    placed = indexed_partitions(checkpointed(t.lineitem.select("l_orderkey")), "i")
    return placed.agg(
        F.count("*").alias("rows_"), F.countDistinct("i").alias("ids"), (F.max("i") == F.count("*") - 1).alias("dense"))


@query("so20_zip", """
    SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer)
    JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS i FROM supplier) USING (i)""")
def _(t):
    left = with_index(t.customer.select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], "i")
    right = with_index(t.supplier.select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), "s_suppkey"], "i")
    return left.join(right, "i").select("c_custkey", "s_suppkey")


@query("so22_map_partitions", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def _(t):
    def double(batches):
        for b in batches:
            yield b.set_column(1, "doubled", pc.multiply(b.column(1), 2.0))

    return t.orders.select("o_orderkey", "o_totalprice").mapInArrow(double, "o_orderkey bigint, doubled double")


@query("so23_pipe", "SELECT upper(n_name) || '|' || n_regionkey AS line FROM nation")
def _(t):
    lines = t.nation.select(F.concat_ws("|", F.lower("n_name"), "n_regionkey").alias("line"))
    piped = lines.rdd.map(lambda r: r.line).pipe("tr a-z A-Z")
    return piped.map(lambda line: (line,)).toDF("line string")


@query("so24_script_transform", "SELECT CAST(s_suppkey AS VARCHAR) AS k, upper(s_name) AS v FROM supplier")
def _(t):
    t.supplier.createOrReplaceTempView("supplier")
    return t.spark.sql("SELECT TRANSFORM (s_suppkey, s_name) USING 'tr a-z A-Z' AS (k string, v string) FROM supplier")


@query("so25_checkpoint", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return checkpointed(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")))


@query("so27_approximate_totals")
def _(t):
    return estimate(t.orders, ["o_orderkey"], "o_totalprice", 0.2)


@query("so28_counters", "SELECT count(*) AS rows_, count(*) FILTER (WHERE o_totalprice < 50000) AS small, max(o_totalprice) AS top FROM orders")
def _(t):
    # in a session of its own: a session that has observed cannot be sent to tasks any more, which
    # some trained models try to do
    own = Tables(t.spark.newSession(), t.path)
    seen = Observation("orders")
    watched = own.orders.observe(
        seen, F.count("*").alias("rows_"), F.count(F.when(F.col("o_totalprice") < 50000, 1)).alias("small"),
        F.max("o_totalprice").alias("top"))
    watched.write.format("noop").mode("overwrite").save()  # the job whose rows are counted
    got = seen.get
    return t.spark.createDataFrame([(got["rows_"], got["small"], got["top"])], "rows_ bigint, small bigint, top double")


@query("so30_glom")
def _(t):
    """Partition contents as arrays of a bounded chunk each, never a whole partition in one row."""
    rows = t.orders.select("o_orderkey").withColumns({"partition": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    chunk = F.expr("(_row & 8589934591) div 1024").alias("chunk")
    return rows.groupBy("partition", chunk).agg(F.collect_list("o_orderkey").alias("keys"))
