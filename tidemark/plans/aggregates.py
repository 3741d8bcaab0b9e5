"""Aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.pieces import map_groups
from tidemark.operators import quantiles
from tidemark.registry import query, same

N = "nullif(l_linenumber % 3, 0)"


@query("ag01_count", f"""
    SELECT l_returnflag, count(*) AS n, count({N}) AS present, count(CASE WHEN {N} IS NOT NULL AND l_tax > 0 THEN 1 END) AS both
    FROM lineitem GROUP BY 1""")
def _(t):
    x = F.expr(N)
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count(x).alias("present"),
        F.expr(f"count({N}, nullif(l_tax, 0))").alias("both"),
    )


@query("ag02_sum", """
    SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS ints, round(sum(l_extendedprice), 2) AS doubles,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) AS decimals FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.sum("l_linenumber").alias("ints"), F.round(F.sum("l_extendedprice"), 2).alias("doubles"),
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("decimals"),
    )


@query("ag03_avg", f"SELECT l_suppkey, round(avg(l_extendedprice), 6) AS mean, round(avg({N}), 6) AS skips_null FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.avg("l_extendedprice"), 6).alias("mean"), F.round(F.avg(F.expr(N)), 6).alias("skips_null"))


@query("ag04_min", "SELECT l_suppkey, min(l_shipdate) AS first_day, min(l_extendedprice) AS cheapest, min(l_returnflag) AS flag FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.min("l_shipdate").alias("first_day"), F.min("l_extendedprice").alias("cheapest"), F.min("l_returnflag").alias("flag"))


@query("ag05_max", "SELECT l_suppkey, max(l_shipdate) AS last_day, max(l_extendedprice) AS dearest, max(l_returnflag) AS flag FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.max("l_shipdate").alias("last_day"), F.max("l_extendedprice").alias("dearest"), F.max("l_returnflag").alias("flag"))


FIRST = """
    SELECT o_custkey, {f}(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS any_status,
           {f}(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (WHERE o_orderstatus <> 'F') AS not_f
    FROM orders GROUP BY 1"""

# first and last depend on row order; the order is named, so partial aggregates agree
for _id, _f in [("ag06_first", "min_by"), ("ag07_last", "max_by")]:
    @query(_id, FIRST.format(f="arg_min" if _f == "min_by" else "arg_max"))
    def _(t, f=_f):
        pick = getattr(F, f)
        order = F.struct("o_orderdate", "o_orderkey")
        kept = F.when(F.col("o_orderstatus") != "F", order)
        return t.orders.groupBy("o_custkey").agg(
            pick("o_orderkey", order).alias("any_status"), pick("o_orderkey", kept).alias("not_f"))


@query("ag08_collect_list", """
    SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS line_numbers FROM lineitem GROUP BY 1""")
def _(t):
    lines = F.sort_array(F.collect_list("l_linenumber"))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(lines.cast("array<string>"), ",").alias("line_numbers"))


@query("ag09_collect_set", "SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"))


PAIRS = [
    ("ag10_corr", "corr", "corr", 9), ("ag11_covar_pop", "covar_pop", "covar_pop", 3),
    ("ag12_covar_samp", "covar_samp", "covar_samp", 3),
]
for _id, _f, _g, _d in PAIRS:
    @query(_id, f"SELECT l_suppkey, round({_g}(l_quantity, l_extendedprice), {_d}) AS v FROM lineitem GROUP BY 1")
    def _(t, f=_f, d=_d):
        return t.lineitem.groupBy("l_suppkey").agg(F.round(getattr(F, f)("l_quantity", "l_extendedprice"), d).alias("v"))


@query("ag13_stddev", """
    SELECT l_suppkey, round(stddev_samp(l_extendedprice), 4) AS std, round(stddev_pop(l_extendedprice), 4) AS pop,
           round(stddev_samp(l_quantity), 6) AS samp FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.stddev("l_extendedprice"), 4).alias("std"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("pop"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("samp"))


@query("ag14_variance", """
    SELECT l_suppkey, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS pop,
           round(var_samp(l_discount), 9) AS samp FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.variance("l_quantity"), 6).alias("v"), F.round(F.var_pop("l_quantity"), 6).alias("pop"),
        F.round(F.var_samp("l_discount"), 9).alias("samp"))


MOMENTS = """SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS m, avg((l_quantity - a) ** 2) AS m2,
    avg((l_quantity - a) ** 3) AS m3, avg((l_quantity - a) ** 4) AS m4
    FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS a FROM lineitem) GROUP BY 1"""


@query("ag15_skewness", f"SELECT l_suppkey, round(m3 / m2 ** 1.5, 6) AS skew FROM ({MOMENTS})")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.skewness("l_quantity"), 6).alias("skew"))


@query("ag16_kurtosis", f"SELECT l_suppkey, round(m4 / (m2 * m2) - 3, 6) AS kurt FROM ({MOMENTS})")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.kurtosis("l_quantity"), 6).alias("kurt"))


@query("ag17_count_distinct", """
    SELECT l_returnflag, count(DISTINCT l_suppkey) AS one, count(DISTINCT (l_suppkey, l_linenumber)) AS two FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("one"), F.countDistinct("l_suppkey", "l_linenumber").alias("two"))


@query("ag18_approx_distinct")
def _(t):
    """Sketch and exact count run apart: beside a distinct count in one aggregation, Spark keeps a sketch per flag and order."""
    approx = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("approx"))
    exact = t.lineitem.groupBy(F.col("l_returnflag").alias("_flag")).agg(F.countDistinct("l_orderkey").alias("exact"))
    return approx.join(exact, F.col("l_returnflag").eqNullSafe(F.col("_flag"))).select("l_returnflag", "approx", "exact")


@query("ag19_percentile", """
    SELECT l_suppkey, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
           round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1""")
def _(t):
    many = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.9)))
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.percentile("l_quantity", 0.5), 6).alias("median"), F.round(many[0], 4).alias("q1"),
        F.round(many[1], 4).alias("p90"))


@query("ag20_approx_percentile")
def _(t):
    approx = t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.1, 0.5, 0.9], 1000).alias("approx"))
    exact = quantiles.exact_quantiles(t.lineitem, "l_extendedprice", [0.5], ["l_returnflag"]).select(
        F.col("l_returnflag").alias("_flag"), F.col("value").alias("exact_median"))
    return approx.join(exact, F.col("l_returnflag").eqNullSafe(F.col("_flag"))).drop("_flag")


@query("ag20_exact_median", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS exact_median FROM lineitem GROUP BY 1")
def _(t):
    return quantiles.exact_quantiles(t.lineitem, "l_extendedprice", [0.5], ["l_returnflag"]).select("l_returnflag", F.col("value").alias("exact_median"))


@query("ag21_quantile_summary", """
    SELECT quantile_disc(l_quantity, 0.25) AS q1, quantile_disc(l_quantity, 0.5) AS q2, quantile_disc(l_quantity, 0.75) AS q3 FROM lineitem""")
def _(t):
    found = quantiles.exact_quantiles(t.lineitem, "l_quantity", [0.25, 0.5, 0.75])
    return found.agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])


@query("ag21_greenwald_khanna", "SELECT CAST(unnest([0.0, 0.1, 0.5, 0.9, 1.0]) AS DOUBLE) AS share, true AS within")
def _(t):
    """A merged summary of error 0.01: are the true ranks of its values that near to the wanted ones?"""
    found = quantiles.quantiles_of(quantiles.summarised(t.lineitem, "l_extendedprice", 0.01), [0.0, 0.1, 0.5, 0.9, 1.0])
    price = F.col("l_extendedprice")
    ranks = t.lineitem.crossJoin(F.broadcast(found)).groupBy("share").agg(  # five rows
        F.count("*").alias("n"), F.count_if(price < F.col("value")).alias("below"), F.count_if(price <= F.col("value")).alias("upto"))
    rank, room = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n"))), 0.01 * F.col("n")
    return ranks.select("share", ((F.col("below") + 1 - rank <= room) & (rank - F.col("upto") <= room)).alias("within"))


same("ag22_group_by_ordinal", """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS y, substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1, 2""")


def priced(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")


TOTALS = "count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty"


def totals():
    return F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("qty")


@query("ag23_rollup", f"SELECT l_returnflag, l_linestatus, {TOTALS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return priced(t).rollup("l_returnflag", "l_linestatus").agg(*totals())


@query("ag24_cube", f"SELECT l_returnflag, l_linestatus, l_linenumber, {TOTALS} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def _(t):
    return priced(t).cube("l_returnflag", "l_linestatus", "l_linenumber").agg(*totals())


@query("ag25_grouping_sets", f"""
    SELECT l_returnflag, l_linestatus, l_linenumber, {TOTALS} FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())""")
def _(t):
    flag, status, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    return priced(t).groupingSets([[flag, status], [number], []], flag, status, number).agg(*totals())


@query("ag26_grouping_id", f"""
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS TINYINT) AS g, grouping_id(l_returnflag, l_linestatus) AS gid, {TOTALS}
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def _(t):
    return priced(t).cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").alias("g"), F.grouping_id().alias("gid"), *totals())


@query("ag27_pivot", """
    SELECT l_returnflag, CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS "F",
           CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS "O" FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity").cast("bigint"))


@query("ag27_pivot_unlisted", """
    SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT",
        count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH", count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
        count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW"
    FROM orders GROUP BY 1""")
def _(t):
    return t.orders.groupBy("o_orderstatus").pivot("o_orderpriority").count().na.fill(0)


@query("ag28_conditional", """
    SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned,
           sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS discounted FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)), 2).alias("returned"),
        F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("discounted"))


@query("ag29_several_distinct", """
    SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days,
           count(DISTINCT substring(o_orderpriority, 1, 1)) AS priorities FROM orders GROUP BY 1""")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderdate").alias("days"),
        F.countDistinct(F.substring("o_orderpriority", 1, 1)).alias("priorities"))


@query("ag30_empty_input", "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS last FROM orders WHERE o_orderkey < 0")
def _(t):
    return t.orders.where("o_orderkey < 0").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderkey").alias("last"))


@query("ag32_typed_aggregators", """
    SELECT c_mktsegment, round(avg(c_acctbal * 2), 6) AS mean, count(*) AS n, round(sum(c_acctbal), 2) AS total,
           CAST(sum(c_nationkey) AS BIGINT) AS longs FROM customer GROUP BY 1""")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(
        F.round(F.avg(F.col("c_acctbal") * 2), 6).alias("mean"), F.count("*").alias("n"),
        F.round(F.sum("c_acctbal"), 2).alias("total"), F.sum(F.col("c_nationkey").cast("bigint")).alias("longs"))


@query("ag33_reduce", """
    SELECT l_orderkey, CAST(bit_xor(l_partkey) AS BIGINT) AS x, bool_or(l_tax > 0.07) AS any_high, max(l_linenumber) AS most FROM lineitem GROUP BY 1""")
def _(t):
    """A commutative, associative function: built-in reductions keep map-side partials."""
    return t.lineitem.groupBy("l_orderkey").agg(
        F.bit_xor("l_partkey").alias("x"), F.bool_or(F.col("l_tax") > 0.07).alias("any_high"), F.max("l_linenumber").alias("most"))


@query("ag34_combine_by_key", """
    SELECT o_custkey, round(sum(o_totalprice) / count(*), 6) AS mean, CAST(sum(o_orderkey % 10) + 100 AS BIGINT) AS folded FROM orders GROUP BY 1""")
def _(t):
    """Create, merge and finish: the buffer's parts are aggregate columns, then an expression."""
    buffers = t.orders.groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 10).alias("digits"))
    return buffers.select(
        "o_custkey", F.round(F.col("total") / F.col("n"), 6).alias("mean"), (F.col("digits") + 100).alias("folded"))


@query("ag35_group_map", """
    SELECT k AS k, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS spread FROM (
        SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS k, o_totalprice FROM orders) GROUP BY 1""")
def _(t):
    """A Python function of groups, though a third of all rows share one key: large groups are
    cut into pieces, the many small ones come together, and the function's partial rows are merged."""
    def partial(rows: pd.DataFrame) -> pd.DataFrame:
        price = rows.groupby("k", dropna=False, sort=False)["o_totalprice"]
        return price.agg(n="size", low="min", high="max").reset_index()

    key = F.expr("CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS k")
    rows = t.orders.select(key, "o_orderkey", "o_totalprice")
    return map_groups(
        rows, "k", F.xxhash64("o_orderkey"), partial, "k bigint, n bigint, low double, high double",
        F.sum("n").alias("n"), (F.max("high") - F.min("low")).alias("spread"), max_rows=1000, many=True)


@query("ag36_histogram_numeric")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.histogram_numeric("l_extendedprice", F.lit(8)).alias("bins")).select(
        "l_returnflag", F.explode("bins").alias("b")).select("l_returnflag", "b.x", "b.y")


@query("ag38_stat_counter", """
    SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(sum(l_quantity), 2) AS total, min(l_quantity) AS low,
           max(l_quantity) AS high, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS stdev FROM lineitem GROUP BY 1""")
def _(t):
    q = "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.sum(q), 2).alias("total"), F.min(q).alias("low"),
        F.max(q).alias("high"), F.round(F.var_pop(q), 6).alias("variance"), F.round(F.stddev_pop(q), 6).alias("stdev"))


@query("ag39_count_by_value", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("ag41_struct_order", """
    SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS dearest,
           arg_min(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS cheapest FROM orders GROUP BY 1""")
def _(t):
    pair = F.struct("o_totalprice", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        F.max(pair)["o_orderkey"].alias("dearest"), F.min(pair)["o_orderkey"].alias("cheapest"))
