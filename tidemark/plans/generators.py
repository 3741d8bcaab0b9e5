"""Row generators, statistics helpers and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.sketches import BloomFilter, CountMin
from tidemark.registry import query

NAME_WORDS = "(SELECT p_partkey, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))"


@query("ge01_explode", f"SELECT p_partkey, word FROM {NAME_WORDS}")
def _(t):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("ge01_explode_map", "SELECT p_partkey, 'size' AS key, p_size AS value FROM part UNION ALL SELECT p_partkey, 'half', p_size // 2 FROM part")
def _(t):
    m = F.create_map(F.lit("size"), F.col("p_size"), F.lit("half"), F.expr("p_size div 2").cast("int"))
    return t.part.select("p_partkey", F.explode(m))


@query("ge02_posexplode", f"SELECT p_partkey, CAST(pos AS INTEGER) AS pos, word FROM {NAME_WORDS}")
def _(t):
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@query("ge03_inline", "SELECT p_partkey, 'brand' AS what, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")
def _(t):
    def row(what, c):
        return F.struct(F.lit(what).alias("what"), F.col(c).alias("v"))

    return t.part.select("p_partkey", F.inline(F.array(row("brand", "p_brand"), row("type", "p_type"))))


@query("ge04_stack", """
    SELECT c_custkey, 'balance' AS measure, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer""")
def _(t):
    return t.customer.select("c_custkey", F.stack(
        F.lit(2), F.lit("balance"), F.col("c_acctbal"), F.lit("nation"), F.col("c_nationkey").cast("double")).alias("measure", "v"))


@query("ge05_lateral_view", f"""
    SELECT w.p_partkey, word, p_brand, p_size + pos AS v FROM {NAME_WORDS} AS w JOIN part USING (p_partkey)
    UNION ALL SELECT p_partkey, NULL, p_brand, NULL FROM part WHERE p_size % 9 = 0""".replace("JOIN part USING (p_partkey)", "JOIN part USING (p_partkey) WHERE p_size % 9 <> 0"))
def _(t):
    return t.sql("""
        SELECT p_partkey, word, p_brand, CAST(p_size + pos AS BIGINT) AS v FROM part
        LATERAL VIEW OUTER posexplode(CASE WHEN p_size % 9 <> 0 THEN split(p_name, ' ') END) w AS pos, word""")


@query("ge06_crosstab", """
    SELECT o_orderstatus AS o_orderstatus_o_orderpriority, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT",
        count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH", count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
        count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW"
    FROM orders GROUP BY 1""")
def _(t):
    return t.orders.crosstab("o_orderstatus", "o_orderpriority")


@query("ge07_frequent_items", """
    SELECT lang AS item, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 0.2 * (SELECT count(*) FROM documents)""")
def _(t):
    """Exact: counts with partial aggregation, then the support filter."""
    total = t.documents.agg((F.count("*") * 0.2).alias("least"))
    counts = t.documents.groupBy(F.col("lang").alias("item")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total), F.col("n") >= F.col("least")).select("item", "n")  # one row


@query("ge07_frequent_items_sketch")
def _(t):
    return t.documents.freqItems(["lang", "source"], 0.2)


@query("ge08_approximate_quantiles")
def _(t):
    probabilities = [0.05, 0.25, 0.5, 0.75, 0.95]
    found = t.lineitem.approxQuantile(["l_extendedprice", "l_quantity"], probabilities, 0.001)
    return t.spark.createDataFrame(list(zip(probabilities, *found)), "p double, price double, quantity double")


@query("ge09_pair_statistics", """
    SELECT round(corr(l_quantity, l_extendedprice), 9) AS corr, round(covar_samp(l_quantity, l_extendedprice), 2) AS cov FROM lineitem""")
def _(t):
    corr = t.lineitem.stat.corr("l_quantity", "l_extendedprice")
    cov = t.lineitem.stat.cov("l_quantity", "l_extendedprice")
    return t.spark.createDataFrame([(round(corr, 9), round(cov, 2))], "corr double, cov double")


@query("ge10_describe", """
    SELECT 'count' AS summary, CAST(count(*) AS DOUBLE) AS balance, CAST(count(*) AS DOUBLE) AS nation FROM customer
    UNION ALL SELECT 'mean', round(avg(c_acctbal), 6), round(avg(c_nationkey), 6) FROM customer
    UNION ALL SELECT 'stddev', round(stddev_samp(c_acctbal), 6), round(stddev_samp(c_nationkey), 6) FROM customer
    UNION ALL SELECT 'min', min(c_acctbal), min(c_nationkey) FROM customer UNION ALL SELECT 'max', max(c_acctbal), max(c_nationkey) FROM customer""")
def _(t):
    found = t.customer.describe("c_acctbal", "c_nationkey")
    return found.select(
        "summary", F.round(F.col("c_acctbal").cast("double"), 6).alias("balance"), F.round(F.col("c_nationkey").cast("double"), 6).alias("nation"))


@query("ge11_bloom_filter")
def _(t):
    """Which orders may belong to a rich customer? Two filters are built apart and merged."""
    rich = t.customer.where("c_acctbal > 5000")
    items = rich.count()
    even = BloomFilter.build(rich.where("c_custkey % 2 = 0"), "c_custkey", items, 0.01)
    odd = BloomFilter.build(rich.where("c_custkey % 2 = 1"), "c_custkey", items, 0.01)
    tested = even.merge(odd).test(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "maybe")
    known = rich.select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("_in"))
    return tested.join(known, "o_custkey", "left").select("o_orderkey", "maybe", F.coalesce("_in", F.lit(False)).alias("member"))


@query("ge12_count_min")
def _(t):
    """Word counts of the documents: the estimate beside the true count."""
    words = t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    first = CountMin.build(words.where("doc_id % 2 = 0"), "word", 0.0005, 0.99)
    sketch = first.merge(CountMin.build(words.where("doc_id % 2 = 1"), "word", 0.0005, 0.99))
    exact = words.groupBy("word").agg(F.count("*").alias("n"))
    return exact.join(sketch.estimate(exact.select("word"), "word"), "word")
