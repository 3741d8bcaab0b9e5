"""Window functions. Partitions are groups of bounded size unless a query says otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import blocks
from tidemark.operators.ordering import row_numbers, with_index, with_running_totals
from tidemark.registry import query, same

# the orders of one customer by date
def by_date():
    return W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


def by_priority():
    return W.partitionBy("o_custkey").orderBy("o_orderpriority")


OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
PRIO_SQL = "OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"


def ranked(name, sql, column):
    @query(name, f"SELECT o_orderkey, {sql} AS v FROM orders")
    def _(t):
        return t.orders.select("o_orderkey", column().alias("v"))


def as_int(sql):
    return f"CAST({sql} AS INTEGER)"


ranked("wi01_row_number", as_int(f"row_number() {OVER}"), lambda: F.row_number().over(by_date()))
ranked("wi02_rank", as_int(f"rank() {PRIO_SQL}"), lambda: F.rank().over(by_priority()))
ranked("wi03_dense_rank", as_int(f"dense_rank() {PRIO_SQL}"), lambda: F.dense_rank().over(by_priority()))
ranked("wi04_percent_rank", f"round(percent_rank() {PRIO_SQL}, 9)", lambda: F.round(F.percent_rank().over(by_priority()), 9))
ranked("wi05_cume_dist", f"round(cume_dist() {PRIO_SQL}, 9)", lambda: F.round(F.cume_dist().over(by_priority()), 9))
ranked("wi06_ntile", as_int(f"ntile(4) {OVER}"), lambda: F.ntile(4).over(by_date()))
ranked("wi07_lag", f"lag(o_totalprice, 1, 0.0) {OVER}", lambda: F.lag("o_totalprice", 1, 0.0).over(by_date()))
ranked("wi08_lead", f"lead(o_orderkey, 2) {OVER}", lambda: F.lead("o_orderkey", 2).over(by_date()))
ranked("wi09_first_value", f"first_value(o_orderkey) {OVER}", lambda: F.first("o_orderkey").over(by_date()))
ranked(
    "wi10_last_value",
    "last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    lambda: F.last("o_orderkey").over(by_date().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
)


@query("wi01_row_number_skewed", """
    SELECT event_id, user_id % 3 = 0 AS hot, row_number() OVER (PARTITION BY user_id % 3 = 0 ORDER BY ts, event_id) AS v FROM events""")
def _(t):
    """Two groups hold all rows: numbered over range partitions, not one task per group."""
    rows = t.events.select("event_id", (F.col("user_id") % 3 == 0).alias("hot"), "ts")
    return row_numbers(rows, ["hot"], ["ts", "event_id"], "v").select("event_id", "hot", "v")


# ---- the same functions where a third of all rows share one key ---------------------------------

HOT = "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END"
HOT_ORDERS = f"(SELECT {HOT} AS k, o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders)"
HOT_W = "PARTITION BY k ORDER BY o_orderdate, o_orderkey"


def hot_orders(t):
    return t.orders.select(F.expr(f"{HOT} AS k"), "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")


def hot_numbered(t):
    return blocks.numbered(hot_orders(t), ["k"], ["o_orderdate", "o_orderkey"])


@query("wi02_ranks_skewed", f"""
    SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist,
           ntile(4) OVER (PARTITION BY k ORDER BY o_orderpriority, o_orderkey) AS ntile FROM {HOT_ORDERS} WINDOW w AS (PARTITION BY k ORDER BY o_orderpriority)""")
def _(t):
    rows = blocks.numbered(hot_orders(t), ["k"], ["o_orderpriority", "o_orderkey"])
    done = blocks.ranks(rows, ["k"], ["o_orderpriority"])
    return done.select(
        "o_orderkey", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"), "ntile")


@query("wi07_lag_lead_skewed", f"""
    SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER w AS before, lead(o_orderkey, 2) OVER w AS second_next FROM {HOT_ORDERS} WINDOW w AS ({HOT_W})""")
def _(t):
    done = blocks.framed(hot_numbered(t), ["k"], 1, 2, {
        "before": lambda w: F.lag("o_totalprice", 1, 0.0).over(w), "second_next": lambda w: F.lead("o_orderkey", 2).over(w)}, block=1000)
    return done.select("o_orderkey", "before", "second_next")


@query("wi09_first_last_skewed", f"""
    SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_value, last_value(o_orderkey) OVER w AS last_value FROM {HOT_ORDERS}
    WINDOW w AS ({HOT_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(t):
    keyed = hot_numbered(t).withColumn("key", F.col("o_orderkey"))
    return blocks.ends(keyed, ["k"], "key").select("o_orderkey", "first_value", "last_value")


@query("wi11_running_skewed", f"""
    SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, min(o_totalprice) OVER w AS low, max(o_totalprice) OVER w AS high, count(*) OVER w AS n FROM {HOT_ORDERS}
    WINDOW w AS ({HOT_W} ROWS UNBOUNDED PRECEDING)""")
def _(t):
    done = blocks.running(hot_numbered(t), ["k"], {
        "total": (F.sum, "o_totalprice"), "low": (F.min, "o_totalprice"), "high": (F.max, "o_totalprice"), "n": (F.count, "o_orderkey")}, block=1000)
    return done.select("o_orderkey", F.round("total", 2).alias("total"), "low", "high", "n")


@query("wi12_rows_frame_skewed", f"""
    SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS v, max(o_orderkey) OVER w AS top FROM {HOT_ORDERS} WINDOW w AS ({HOT_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def _(t):
    done = blocks.framed(hot_numbered(t), ["k"], 2, 1, {
        "v": lambda w: F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 1)), 2), "top": lambda w: F.max("o_orderkey").over(w.rowsBetween(-2, 1))}, block=1000)
    return done.select("o_orderkey", "v", "top")


@query("wi23_sliding_skewed", f"""
    SELECT k, a, b, c FROM (SELECT k, o_orderkey AS a, lead(o_orderkey, 1) OVER w AS b, lead(o_orderkey, 2) OVER w AS c FROM {HOT_ORDERS} WINDOW w AS ({HOT_W})) WHERE c IS NOT NULL""")
def _(t):
    done = blocks.framed(hot_numbered(t), ["k"], 0, 2, {"g": lambda w: F.collect_list("o_orderkey").over(w.rowsBetween(0, 2))}, block=1000)
    groups = done.where(F.size("g") == 3)
    return groups.select("k", F.col("g")[0].alias("a"), F.col("g")[1].alias("b"), F.col("g")[2].alias("c"))


@query("wi11_aggregates", f"""
    SELECT o_orderkey, round(sum(o_totalprice) {OVER}, 2) AS total, round(avg(o_totalprice) {OVER}, 8) AS mean, min(o_totalprice) {OVER} AS low,
           max(o_totalprice) {OVER} AS high, count(*) {OVER} AS n, round(coalesce(stddev_pop(o_totalprice) {OVER}, 0), 3) AS dev FROM orders""")
def _(t):
    p = "o_totalprice"
    return t.orders.select(
        "o_orderkey", F.round(F.sum(p).over(by_date()), 2).alias("total"), F.round(F.avg(p).over(by_date()), 8).alias("mean"),
        F.min(p).over(by_date()).alias("low"), F.max(p).over(by_date()).alias("high"), F.count("*").over(by_date()).alias("n"),
        F.round(F.stddev_pop(p).over(by_date()), 3).alias("dev"))


@query("wi12_rows_frame", f"""
    SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS v FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(by_date().rowsBetween(-2, 1)), 2).alias("v"))


@query("wi13_range_frame", """
    SELECT l_orderkey, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM lineitem""")
def _(t):
    near = W.partitionBy("l_suppkey").orderBy("l_quantity").rangeBetween(-2, 2)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.count("*").over(near).alias("v"))


@query("wi14_frame_marks", """
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_over,
           count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", F.count("*").over(by_date().rowsBetween(W.currentRow, W.unboundedFollowing)).alias("left_over"),
        F.count("*").over(by_date().rowsBetween(W.unboundedPreceding, W.currentRow)).alias("so_far"))


@query("wi15_partition_or_order", """
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS in_group, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place,
           CAST(sum(o_custkey) OVER (ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running, count(*) OVER () AS overall FROM orders""")
def _(t):
    """Order-only and empty windows without the single task a plain window would use."""
    grouped = t.orders.select(
        "o_orderkey", "o_totalprice", "o_custkey", F.count("*").over(W.partitionBy("o_custkey")).alias("in_group"))
    placed = with_running_totals(
        grouped.withColumn("_one", F.lit(1)), ["o_totalprice", "o_orderkey"], {"running": "o_custkey", "_place": "_one"})
    overall = t.orders.agg(F.count("*").alias("overall"))
    return placed.crossJoin(F.broadcast(overall)).select(  # one row
        "o_orderkey", "in_group", (F.col("_place") - 1).cast("bigint").alias("place"), "running", "overall")


@query("wi16_null_order", """
    SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY nullif(c_custkey % 4, 0) DESC NULLS LAST, c_custkey) AS INTEGER) AS last_,
           CAST(row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY nullif(c_custkey % 4, 0) ASC NULLS FIRST, c_custkey) AS INTEGER) AS first_ FROM customer""")
def _(t):
    """A segment of a nation may hold any share of the customers: numbered over range partitions."""
    keys, x = ["c_mktsegment", "c_nationkey"], F.col("x")
    rows = t.customer.select("c_custkey", *keys, F.expr("nullif(c_custkey % 4, 0)").alias("x"))
    last = row_numbers(rows, keys, [x.desc_nulls_last(), "c_custkey"], "last_")
    both = row_numbers(last, keys, [x.asc_nulls_first(), "c_custkey"], "first_")
    return both.select("c_custkey", F.col("last_").cast("int"), F.col("first_").cast("int"))


same("wi17_named_window", """
    SELECT o_orderkey, min(o_totalprice) OVER w AS low, max(o_totalprice) OVER w AS high FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")


@query("wi18_several_partitionings", """
    SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS INTEGER) AS in_brand,
           round(sum(p_retailprice) OVER (PARTITION BY p_type, p_size), 2) AS of_type FROM part""")
def _(t):
    """Few brands hold all parts: ranks from range partitions, sums per type and size joined back."""
    rows = t.part.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    ranked_ = blocks.rank(blocks.numbered(rows, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"]), ["p_brand"], ["p_retailprice"], name="in_brand")
    summed = blocks.over_key(ranked_, ["p_type", "p_size"], F.sum("p_retailprice").alias("s"))
    return summed.select("p_partkey", F.col("in_brand").cast("int"), F.round("s", 2).alias("of_type"))


@query("wi19_over_aggregate", """
    SELECT p_brand, p_type, round(sum(p_retailprice), 2) AS price, round(sum(p_retailprice) * 100 / sum(sum(p_retailprice)) OVER (PARTITION BY p_brand), 6) AS share
    FROM part GROUP BY 1, 2""")
def _(t):
    grouped = t.part.groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("s"))
    return grouped.select(
        "p_brand", "p_type", F.round("s", 2).alias("price"),
        F.round(F.col("s") * 100 / F.sum("s").over(W.partitionBy("p_brand")), 6).alias("share"))


@query("wi20_top_n", """
    SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice, CAST(r AS INTEGER) AS r FROM (
        SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 3""")
def _(t):
    # the rank filter is pushed below the shuffle, so at most 3 rows per key and task move
    top = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"))
    return t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice").withColumn(
        "r", F.rank().over(top)).where("r <= 3")


@query("wi21_running_total", """
    SELECT month, round(total, 2) AS total, round(sum(total) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS running,
           round(avg(total) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM (
        SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1)""")
def _(t):
    # one row per calendar month reaches the window
    months = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        F.sum("o_totalprice").alias("total"))
    by = W.orderBy("month")
    return months.select(
        "month", F.round("total", 2).alias("total"),
        F.round(F.sum("total").over(by.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.avg("total").over(by.rowsBetween(-2, 0)), 4).alias("moving"))


@query("wi22_percentile_window")
def _(t):
    by = W.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", "o_custkey", F.percentile_approx("o_totalprice", 0.5, 1000).over(by).alias("median"))


@query("wi23_sliding", """
    SELECT o_custkey, a, b, c FROM (SELECT o_custkey, o_orderkey AS a, lead(o_orderkey, 1) OVER w AS b, lead(o_orderkey, 2) OVER w AS c
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE c IS NOT NULL""")
def _(t):
    group = F.collect_list("o_orderkey").over(by_date().rowsBetween(0, 2))
    groups = t.orders.select("o_custkey", group.alias("g")).where(F.size("g") == 3)
    return groups.select("o_custkey", F.col("g")[0].alias("a"), F.col("g")[1].alias("b"), F.col("g")[2].alias("c"))


@query("wi23_sliding_whole_table", """
    SELECT a, b, c FROM (SELECT o_orderkey AS a, lead(o_orderkey, 1) OVER w AS b, lead(o_orderkey, 2) OVER w AS c
        FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)) WHERE c IS NOT NULL""")
def _(t):
    """Sliding over the whole ordered table: rows are sent to the three groups they belong to."""
    n = 3
    placed = with_index(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "i")
    offset = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("offset")
    sent = placed.select("o_orderkey", "i", offset).withColumn("start", F.col("i") - F.col("offset")).where("start >= 0")
    groups = sent.groupBy("start").agg(
        F.count("*").alias("size"), *[F.max(F.when(F.col("offset") == k, F.col("o_orderkey"))).alias("abc"[k]) for k in range(n)])
    return groups.where(F.col("size") == n).select("a", "b", "c")
