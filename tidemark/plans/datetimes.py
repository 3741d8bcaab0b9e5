"""Date, time and interval functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.projection import project
from tidemark.registry import query

DAY = "CAST(o_orderdate AS DATE)"


def part(name, table, sql, column):
    project(name, table, f"CAST({sql} AS INTEGER)", column)


project("df01_date_add", "orders", f"{DAY} + CAST(o_orderkey % 90 AS INTEGER)", lambda: F.date_add("o_orderdate", (F.col("o_orderkey") % 90).cast("int")))
project("df02_date_sub", "orders", f"{DAY} - 45", lambda: F.date_sub("o_orderdate", 45))
part("df03_datediff", "orders", f"{DAY} - DATE '1998-06-15'", lambda: F.datediff("o_orderdate", F.lit("1998-06-15").cast("date")))
part("df04_day", "orders", "day(o_orderdate)", lambda: F.day("o_orderdate"))
part("df05_dayofmonth", "orders", "dayofmonth(o_orderdate)", lambda: F.dayofmonth("o_orderdate"))
project("df06_from_unixtime", "orders", "strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%d %H:%M:%S')", lambda: F.from_unixtime(F.col("o_orderkey") * 86399))
part("df07_hour", "events", "hour(ts)", lambda: F.hour("ts"))
part("df08_minute", "events", "minute(ts)", lambda: F.minute("ts"))
part("df09_month", "orders", "month(o_orderdate)", lambda: F.month("o_orderdate"))
part("df10_second", "events", "second(ts)", lambda: F.second("ts"))
project("df11_to_date", "events", "CAST(ts AS DATE)", lambda: F.to_date("ts"))
project("df12_to_unix_timestamp", "orders", "CAST(epoch(strptime(strftime(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d')) AS BIGINT)",
        lambda: F.to_unix_timestamp(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("yyyy/MM/dd")))
project("df13_unix_timestamp", "events", "CAST(floor(epoch(ts)) AS BIGINT)", lambda: F.unix_timestamp(F.col("ts").cast("timestamp")))
part("df14_weekofyear", "orders", "weekofyear(o_orderdate)", lambda: F.weekofyear("o_orderdate"))


@query("dt20_current", "SELECT 1::BIGINT AS dates, 1::BIGINT AS instants, true AS later FROM orders LIMIT 1")
def _(t):
    """One value per query, however many rows and tasks read it."""
    rows = t.orders.select(F.current_date().alias("d"), F.current_timestamp().alias("n"), "o_orderdate")
    return rows.agg(
        F.countDistinct("d").alias("dates"), F.countDistinct("n").alias("instants"),
        F.bool_and(F.col("n") > F.col("o_orderdate").cast("timestamp")).alias("later"))


project("dt21_interval_arithmetic", "orders", "o_orderdate + INTERVAL 1 MONTH - INTERVAL 3 DAY + INTERVAL 90 MINUTE",
        lambda: F.expr("o_orderdate + interval 1 month - interval 3 days + interval 90 minutes"))


@query("dt22_time_bucket", """
    SELECT bucket_start, bucket_start + INTERVAL 6 HOUR AS bucket_end, count(*) AS n FROM (
        SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts - INTERVAL 1 HOUR, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR,
                       time_bucket(INTERVAL 3 HOUR, ts - INTERVAL 1 HOUR, TIMESTAMP '1970-01-01') - INTERVAL 2 HOUR]) AS bucket_start FROM events) GROUP BY 1""")
def _(t):
    # six hours long, every three hours, starting at one o'clock
    w = F.window("ts", "6 hours", "3 hours", "1 hour")
    return t.events_ts.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), F.col("w.end").cast("timestamp_ntz").alias("bucket_end"), "n")


@query("dt23_date_parts", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
           CAST(dayofweek(CAST(o_orderdate AS DATE)) + 1 AS INTEGER) AS dow, last_day(o_orderdate) AS month_end FROM orders""")
def _(t):
    d = "o_orderdate"
    return t.orders.select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.dayofyear(d).alias("doy"), F.dayofweek(F.to_date(d)).alias("dow"),
        F.last_day(d).alias("month_end"))


# a zone without summer time, so that the check needs no zone tables
project("dt24_from_utc", "events", "ts + INTERVAL 330 MINUTE", lambda: F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata").cast("timestamp_ntz"))
project("dt26_to_utc", "events", "ts - INTERVAL 330 MINUTE", lambda: F.to_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata").cast("timestamp_ntz"))
project("dt25_calendar_interval", "orders", "o_orderdate + to_months(CAST(o_orderkey % 30 AS INTEGER)) + to_days(CAST(o_orderkey % 11 AS INTEGER)) + to_hours(5)",
        lambda: F.col("o_orderdate") + F.make_interval(months=(F.col("o_orderkey") % 30).cast("int"), days=(F.col("o_orderkey") % 11).cast("int"), hours=F.lit(5)))
