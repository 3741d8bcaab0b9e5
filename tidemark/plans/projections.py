"""Projections, filters, predicates and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.antijoin import not_in
from tidemark.registry import query, same


@query("pr01_select", "SELECT c_custkey AS id, upper(c_mktsegment) AS segment, c_acctbal * 2 AS doubled FROM customer")
def _(t):
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.upper("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") * 2).alias("doubled"),
    )


@query("pr02_filter", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
def _(t):
    return t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000))


@query("pr03_comparison", """
    SELECT p_partkey, p_size = 10 AS eq, p_size < 10 AS lt, p_size > 10 AS gt, p_size <= 10 AS le,
           p_size >= 10 AS ge, p_size <> 10 AS ne FROM part""")
def _(t):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey", (size == 10).alias("eq"), (size < 10).alias("lt"), (size > 10).alias("gt"),
        (size <= 10).alias("le"), (size >= 10).alias("ge"), (size != 10).alias("ne"),
    )


NULLED = "nullif(c_nationkey % 5, 0)"


@query("pr04_null_safe_equality", f"""
    SELECT c_custkey, {NULLED} IS NOT DISTINCT FROM nullif(c_custkey % 3, 0) AS safe,
           {NULLED} = nullif(c_custkey % 3, 0) AS plain FROM customer""")
def _(t):
    a = F.expr(NULLED).cast("bigint")
    b = F.expr("nullif(c_custkey % 3, 0)")
    return t.customer.select("c_custkey", a.eqNullSafe(b).alias("safe"), (a == b).alias("plain"))


@query("pr05_in_list", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#5', 'Brand#17')")
def _(t):
    return t.part.where(F.col("p_brand").isin("Brand#1", "Brand#5", "Brand#17")).select("p_partkey", "p_brand")


@query("pr06_is_null", f"SELECT c_custkey, {NULLED} IS NULL AS missing, {NULLED} IS NOT NULL AS present FROM customer")
def _(t):
    x = F.expr(NULLED)
    return t.customer.select("c_custkey", x.isNull().alias("missing"), x.isNotNull().alias("present"))


@query("pr07_three_valued_logic", f"""
    SELECT c_custkey, ({NULLED} > 2) AND (c_acctbal > 0) AS both, ({NULLED} > 2) OR (c_acctbal > 0) AS either,
           NOT ({NULLED} > 2) AS negated FROM customer""")
def _(t):
    a, b = F.expr(NULLED) > 2, F.col("c_acctbal") > 0
    return t.customer.select("c_custkey", (a & b).alias("both"), (a | b).alias("either"), (~a).alias("negated"))


@query("pr08_like", """
    SELECT p_partkey, p_name LIKE '%ring%' AS contains, p_name LIKE 'red%' AS starts, p_name LIKE '%bolt' AS ends,
           p_name LIKE '_e% %' AS wildcard FROM part""")
def _(t):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey", name.contains("ring").alias("contains"), name.startswith("red").alias("starts"),
        name.endswith("bolt").alias("ends"), name.like("_e% %").alias("wildcard"),
    )


@query("pr09_rlike", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*[gt]$')")
def _(t):
    return t.part.where(F.col("p_name").rlike("^(red|blue) .*[gt]$")).select("p_partkey", "p_name")


@query("pr10_between", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def _(t):
    return t.orders.where(F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))).select("o_orderkey")


@query("pr11_cast", """
    SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS to_int, CAST(c_custkey AS VARCHAR) AS to_text,
           CAST(c_custkey AS DOUBLE) AS to_double, CAST(c_custkey % 2 AS BOOLEAN) AS to_bool,
           CAST(c_custkey % 100 AS TINYINT) AS to_byte, CAST(c_custkey % 1000 AS SMALLINT) AS to_short,
           TRY_CAST(CASE WHEN c_custkey % 2 = 0 THEN '12' ELSE c_name END AS INTEGER) AS bad_is_null,
           TRY_CAST('2001-0' || (1 + c_custkey % 9) || '-15' AS DATE) AS to_date,
           CAST(TRY_CAST(trunc(c_acctbal) AS DECIMAL(12, 2)) AS DOUBLE) AS to_decimal FROM customer""")
def _(t):
    key = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", F.col("c_acctbal").cast("int").alias("to_int"), key.cast("string").alias("to_text"),
        key.cast("double").alias("to_double"), (key % 2).cast("boolean").alias("to_bool"),
        (key % 100).cast("tinyint").alias("to_byte"), (key % 1000).cast("smallint").alias("to_short"),
        F.when(key % 2 == 0, F.lit("12")).otherwise(F.col("c_name")).try_cast("int").alias("bad_is_null"),
        F.concat(F.lit("2001-0"), (1 + key % 9).cast("string"), F.lit("-15")).try_cast("date").alias("to_date"),
        F.col("c_acctbal").cast("int").cast("decimal(12,2)").cast("double").alias("to_decimal"),
    )


@query("pr12_nested_access", """
    SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[3] AS DOUBLE) AS third, label AS field, label + 1 AS value
    FROM embeddings""")
def _(t):
    nested = t.embeddings.select(
        "vec_id", "embedding", F.struct("label").alias("s"),
        F.create_map(F.lit("next"), F.col("label") + 1).alias("m"),
    )
    return nested.select(
        "vec_id", F.col("embedding").getItem(0).cast("double").alias("first"),
        F.col("embedding")[2].cast("double").alias("third"), F.col("s").getField("label").alias("field"),
        F.col("m")["next"].alias("value"),
    )


@query("pr13_regex_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(t):
    return t.customer.select(t.customer.colRegex("`c_(custkey|na.*)`"))


same("pr14_common_table_expression", """
    WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
         best AS (SELECT max(total) AS top FROM totals)
    SELECT o_custkey, round(total, 2) AS total FROM totals, best WHERE total > 0.5 * top""")

same("pr15_scalar_subquery", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM orders)""")

same("pr15_correlated_scalar_subquery", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders AS o
    WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = o.o_custkey)""")


@query("pr16_exists", """
    SELECT c_custkey, true AS buys FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
    UNION ALL
    SELECT c_custkey, false FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def _(t):
    pending = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    buyers = t.customer.select("c_custkey")
    return buyers.join(pending, "c_custkey", "left_semi").withColumn("buys", F.lit(True)).union(
        buyers.join(pending, "c_custkey", "left_anti").withColumn("buys", F.lit(False))
    )


@query("pr17_in_subquery", """
    SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)
      AND p_size NOT IN (SELECT l_linenumber FROM lineitem)""")
def _(t):
    full = t.lineitem.where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return not_in(t.part.join(full, "p_partkey", "left_semi"), "p_size", t.lineitem, "l_linenumber").select("p_partkey", "p_name")


@query("pr17_not_in_with_nulls", """
    SELECT (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (
                SELECT nullif(c_nationkey, 3) FROM customer WHERE c_acctbal > 9800)) AS none_with_null,
           (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (
                SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)) AS some_without""")
def _(t):
    rich = t.customer.where("c_acctbal > 9800").select("c_nationkey", F.expr("nullif(c_nationkey, 3)").alias("nulled"))
    counts = [not_in(t.nation, "n_nationkey", rich, c).agg(F.count("*").alias(name)) for c, name in (("nulled", "none_with_null"), ("c_nationkey", "some_without"))]
    return counts[0].crossJoin(F.broadcast(counts[1]))  # one row each

same("pr18_having", """
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 2000000""")


@query("pr19_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("pr20_columns", """
    SELECT s_suppkey, s_name AS title, s_nationkey, round(s_acctbal / 100, 6) AS hundreds FROM supplier""")
def _(t):
    return (
        t.supplier.withColumn("hundreds", F.round(F.col("s_acctbal") / 100, 6))
        .withColumnRenamed("s_name", "title").drop("s_acctbal")
    )


@query("pr21_select_expr", "SELECT p_partkey * 2 AS twice, substring(p_type, 1, 3) AS kind FROM part")
def _(t):
    return t.part.selectExpr("p_partkey * 2 as twice", "substring(p_type, 1, 3) as kind")


@query("pr22_literals", """
    SELECT c_custkey, CAST(1 AS TINYINT) AS y, CAST(2 AS SMALLINT) AS s, CAST(3 AS BIGINT) AS l, CAST(4.5 AS DOUBLE) AS d,
           CAST(1.25 AS DECIMAL(3, 2)) AS bd, DATE '2001-02-03' AS dt, TIMESTAMP '2001-02-03 04:05:06' AS ts, 'text' AS txt,
           true AS b, CAST(NULL AS VARCHAR) AS n, '1A2B' AS hex,
           CAST(epoch(TIMESTAMP '2001-02-03 04:05:06' + INTERVAL 3 WEEK + INTERVAL 4 DAY + INTERVAL 5 HOUR + INTERVAL 6 MINUTE + INTERVAL 7 SECOND) AS BIGINT) AS moved
    FROM customer""")
def _(t):
    return t.customer.selectExpr(
        "c_custkey", "1Y as y", "2S as s", "3L as l", "4.5D as d", "1.25BD as bd", "date '2001-02-03' as dt",
        "timestamp_ntz '2001-02-03 04:05:06' as ts", "'text' as txt", "true as b", "cast(null as string) as n",
        "hex(x'1A2B') as hex",
        "unix_timestamp(timestamp '2001-02-03 04:05:06' + interval 3 week 4 day 5 hour 6 minute 7 seconds) as moved",
    )


@query("pr23_outer_explode", """
    SELECT doc_id, word FROM (SELECT doc_id, unnest(CASE WHEN n_chars < 200 THEN [NULL] ELSE list_distinct(string_split(source, 'r')) END) AS word FROM documents)""")
def _(t):
    parts = F.when(F.col("n_chars") >= 200, F.array_distinct(F.split("source", "r")))
    return t.documents.select("doc_id", F.explode_outer(parts).alias("word"))
