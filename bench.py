"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and threads."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark import registry  # noqa: E402
from tidemark.lineage import latency  # noqa: E402
from tidemark.plans.lineage import order_totals, revenue_by_nation, word_count  # noqa: E402
from tidemark.session import local_session  # noqa: E402
from tidemark.tables import Tables  # noqa: E402

NAMED = [
    "wl08_pricing_summary", "wl08_shipping_priority", "jo17_star", "jo16_skewed", "ag24_cube", "ag29_several_distinct", "wi20_top_n",
    "so01_global_sort", "so05_top_k", "so11_bernoulli_sample", "so11_poisson_sample", "wl01_word_count", "wl03_inverted_index",
    "ln17_go_back", "ln33_trace_latency", "ln33_carried_latency", "ln41_removal_state", "ln44_slowest_inputs", "ln52_delta_debugging",
    "gx17_page_rank", "gx18_connected_components_urgent", "gx20_triangle_count", "ev16_gramian", "ss13_tumbling_window",
]


def range_filter_sum(t: Tables) -> DataFrame:
    """2.1 billion generated rows: range, filter, sum."""
    return t.spark.range(500 << 22).where("(id & 1) = 1").agg(F.sum("id"))


def range_limit_sum(t: Tables) -> DataFrame:
    return t.spark.range(500 << 20).limit(1_000_000).agg(F.sum("id"))


def chained_maps(t: Tables) -> DataFrame:
    df = t.spark.range(100_000_000)
    for _ in range(10):
        df = df.select((F.col("id") + 1).alias("id"))
    return df.agg(F.count("id"))


def chained_filters(t: Tables) -> DataFrame:
    df = t.spark.range(100_000_000)
    for _ in range(10):
        df = df.where("(id & 1) = 1")
    return df.agg(F.count("id"))


def sum_100m(t: Tables) -> DataFrame:
    return t.spark.range(100_000_000).agg(F.sum("id"))


def sample_without_replacement(t: Tables) -> DataFrame:
    return t.spark.range(500 << 18).sample(False, 0.01, 1).agg(F.sum("id"))


def sample_with_replacement(t: Tables) -> DataFrame:
    return t.spark.range(500 << 18).sample(True, 0.01, 1).agg(F.sum("id"))


def sort_25m(t: Tables) -> DataFrame:
    return t.spark.range(25_000_000).select(F.xxhash64("id").alias("k")).sort("k")


ENGINE = {f.__name__: f for f in (
    range_filter_sum, range_limit_sum, chained_maps, chained_filters, sum_100m, sample_without_replacement, sample_with_replacement,
    sort_25m)}

# a pipeline without ids, with ids and costs, and with its latencies read: the price of capture
CAPTURE = {
    "capture_off_word_count": lambda t: word_count(t, capture=False).df,
    "capture_on_word_count": lambda t: word_count(t).df,
    "capture_on_revenue": lambda t: revenue_by_nation(t).df,
    "capture_latency_orders": lambda t: latency.carried_latency(order_totals(t)),
}


def timed(df_of, t: Tables, runs: int = 2) -> float:
    """Best of ``runs``; every row is computed and dropped."""
    best = float("inf")
    for _ in range(runs):
        began = time.perf_counter()
        df_of(t).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def collected(t: Tables, rows: int, runs: int = 2) -> float:
    """Bring rows to the driver as Arrow batches."""
    best = float("inf")
    for _ in range(runs):
        began = time.perf_counter()
        assert t.spark.range(rows).toArrow().num_rows == rows
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    t = Tables(spark, path)
    all_queries = registry.queries()
    work = {**{n: all_queries[n].build for n in NAMED}, **CAPTURE, **ENGINE}
    t.lineitem.count()  # start the executors' readers once
    times = {}
    for name, df_of in work.items():
        times[name] = timed(df_of, t)
    for millions in (1, 2, 4):
        times[f"collect_{millions}m"] = collected(t, millions * 1_000_000)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
