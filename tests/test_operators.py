"""Library operators against brute force."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, sampling
from tidemark.operators.estimates import estimate
from tidemark.operators.ordering import average_ranks, number_copies, row_numbers, with_index, with_running_totals
from tidemark.operators.pieces import map_groups
from tidemark.operators.ranges import point_in_range
from tidemark.operators.sketches import BloomFilter, CountMin
from tidemark.operators.skew import hot_keys, skew_join


@pytest.fixture(scope="module")
def skewed(spark):
    """One key, and the null key, hold most rows."""
    rng = random.Random(1)
    rows = [(i, None if i % 5 == 0 else (0 if i % 3 else rng.randint(1, 9)), rng.randint(0, 20), float(rng.randint(0, 1000))) for i in range(600)]
    return spark.createDataFrame(rows, "id int, k int, o int, v double")


def frame(df):
    return pd.DataFrame([r.asDict() for r in df.collect()])


def test_with_index(spark, skewed):
    got = frame(with_index(skewed, ["o", "id"], "i")).sort_values("i")
    want = frame(skewed).sort_values(["o", "id"])
    assert list(got["i"]) == list(range(600)) and list(got["id"]) == list(want["id"])


def test_running_totals(skewed):
    got = frame(with_running_totals(skewed, ["o", "id"], {"run": "v"})).sort_values(["o", "id"])
    assert list(got["run"]) == list(got["v"].cumsum())


def test_average_ranks(skewed):
    got = frame(average_ranks(skewed, "o")).set_index("o")["rank"]
    data = frame(skewed)
    want = data.assign(r=data["o"].rank()).groupby("o")["r"].first()
    assert got.to_dict() == want.to_dict()


def test_row_numbers_per_key_with_nulls(skewed):
    got = frame(row_numbers(skewed, ["k"], ["o", "id"], "n"))
    data = frame(skewed).sort_values(["o", "id"])
    want = data.groupby("k", dropna=False).cumcount() + 1
    assert dict(zip(got["id"], got["n"])) == dict(zip(data["id"], want))


def test_number_copies_in_chunks(spark):
    df = spark.createDataFrame([("a",)] * 25 + [("b",)] * 3, "x string")
    got = sorted((r.x, r.copy) for r in number_copies(df, chunk=10).collect())
    assert got == [("a", i) for i in range(25)] + [("b", i) for i in range(3)]


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_framed_windows(skewed, block):
    rows = blocks.numbered(skewed, ["k"], ["o", "id"])
    got = frame(blocks.framed(rows, ["k"], 2, 3, {
        "s": lambda w: F.sum("v").over(w.rowsBetween(-2, 3)), "p": lambda w: F.lag("id", 2).over(w), "q": lambda w: F.lead("id", 3).over(w)}, block=block))
    assert len(got) == 600
    by_id = got.set_index("id")
    for _, g in frame(skewed).sort_values(["o", "id"]).groupby("k", dropna=False):
        ids, vs = list(g["id"]), list(g["v"])
        for i, key in enumerate(ids):
            row = by_id.loc[key]
            assert row["s"] == sum(vs[max(0, i - 2):i + 4])
            assert (pd.isna(row["p"]) and i < 2) or row["p"] == ids[i - 2]
            assert (pd.isna(row["q"]) and i + 3 >= len(ids)) or row["q"] == ids[i + 3]


def test_running_windows(skewed):
    rows = blocks.numbered(skewed, ["k"], ["o", "id"])
    got = frame(blocks.running(rows, ["k"], {"s": (F.sum, "v"), "lo": (F.min, "v"), "hi": (F.max, "v"), "n": (F.count, "v")}, block=4)).set_index("id")
    for _, g in frame(skewed).sort_values(["o", "id"]).groupby("k", dropna=False):
        for key, s, lo, hi, n in zip(g["id"], g["v"].cumsum(), g["v"].cummin(), g["v"].cummax(), range(1, len(g) + 1)):
            r = got.loc[key]
            assert (r["s"], r["lo"], r["hi"], r["n"]) == (s, lo, hi, n)


def test_ranks_equal_plain_windows(spark, skewed):
    from pyspark.sql.window import Window as W

    rows = blocks.numbered(skewed, ["k"], ["o", "id"])
    got = {r.id: (r["rank"], r.dense_rank, r.percent_rank, r.cume_dist, r.ntile) for r in blocks.ranks(rows, ["k"], ["o"]).collect()}
    w, exact = W.partitionBy("k").orderBy("o"), W.partitionBy("k").orderBy("o", "id")
    plain = skewed.select("id", F.rank().over(w), F.dense_rank().over(w), F.percent_rank().over(w), F.cume_dist().over(w), F.ntile(4).over(exact))
    assert got == {r[0]: tuple(r[1:]) for r in plain.collect()}


def test_skew_join_equals_join(spark, skewed):
    right = spark.createDataFrame([(i, f"n{i}") for i in range(12)] + [(0, "again")], "k int, name string")
    assert [r.k for r in hot_keys(skewed, "k", 0.3).collect()] == [0]
    got = sorted((r.id, r.name) for r in skew_join(skewed, right, "k", share=0.3, salts=5).collect())
    want = sorted((r.id, r.name) for r in skewed.join(right, "k").collect())
    assert got == want


def test_point_in_range_equals_nested_loop(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-50, 50)) for i in range(200)]
    ranges = [(j, a, a + rng.uniform(0, 15)) for j, a in enumerate(rng.uniform(-60, 50) for _ in range(40))]
    p, r = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(ranges, "j int, a double, b double")
    got = sorted((x.i, x.j) for x in point_in_range(p, r, F.col("x"), F.col("a"), F.col("b"), 5.0).collect())
    assert got == sorted((i, j) for i, x in points for j, a, b in ranges if a <= x < b)


def test_map_groups_merges_pieces(skewed):
    def partial(rows):
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "n": [len(rows)], "s": [rows["v"].sum()]})

    got = map_groups(skewed.where("k IS NOT NULL"), "k", F.xxhash64("id"), partial, "k int, n bigint, s double",
                     F.sum("n").alias("n"), F.sum("s").alias("s"), max_rows=20)
    want = skewed.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).toDF("id")
    a = {r.id for r in sampling.bernoulli(df, ["id"], 0.2, 4).collect()}
    b = {r.id for r in sampling.bernoulli(df.repartition(7), ["id"], 0.2, 4).collect()}
    assert a == b and 800 < len(a) < 1200


def test_stratified_exact_and_fixed_size(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("string").alias("s"))
    got = {r.s: r.n for r in sampling.stratified_exact(df, ["id"], "s", 0.1, 2).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert got == {"true": 34, "false": 67}
    assert sampling.fixed_size(df, ["id"], 50, 1).count() == 50


def test_split_is_disjoint_and_whole(spark):
    df = spark.range(3000).toDF("id")
    parts = [{r.id for r in p.collect()} for p in sampling.split(df, ["id"], [6, 3, 1], 5)]
    assert sum(map(len, parts)) == 3000 and len(set.union(*parts)) == 3000
    assert 1600 < len(parts[0]) < 2000


def test_estimates_cover_the_truth(spark):
    df = spark.range(20000).select("id", (F.col("id") % 100).cast("double").alias("v"))
    got = {r.what: r for r in estimate(df, ["id"], "v", 0.3, 0.999).collect()}
    for what, truth in {"count": 20000, "sum": 990000.0, "mean": 49.5}.items():
        assert got[what].low <= truth <= got[what].high


def test_bloom_filter(spark):
    members = spark.range(0, 3000, 3).toDF("k")
    bloom = BloomFilter.build(members, "k", 1000, 0.02)
    keys = spark.range(3000).toDF("k")
    got = {r.k: r.maybe for r in bloom.test(keys, "k", "maybe").collect()}
    assert all(got[k] for k in range(0, 3000, 3))
    wrong = sum(got[k] for k in range(3000) if k % 3)
    assert wrong < 0.04 * 2000


def test_count_min(spark):
    words = spark.range(5000).select((F.col("id") % 37 * F.col("id") % 101).alias("w"))
    sketch = CountMin.build(words, "w", 0.01, 0.99)
    exact = words.groupBy("w").agg(F.count("*").alias("n"))
    rows = exact.join(sketch.estimate(exact.select("w"), "w"), "w").collect()
    assert all(r.estimate >= r.n for r in rows)
    assert sum(r.estimate - r.n > 0.01 * 5000 for r in rows) <= 0.05 * len(rows)


def test_rank_of_hot_keys_without_a_window(spark):
    """Ties share a rank, NaN comes last and equals itself, a null key is a key; no window runs over a key."""
    rows = [(i, None if i % 3 == 0 else "hot", float("nan") if i % 5 == 0 else float(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, k string, d double").repartition(4)
    ranked = blocks.rank(blocks.numbered(df, ["k"], ["d", "id"]), ["k"], ["d"])
    assert "Window" not in ranked._jdf.queryExecution().optimizedPlan().toString()

    def place(d):
        return (d != d, 0 if d != d else d)

    expected = {i: 1 + sum(k2 == k and place(d2) < place(d) for _, k2, d2 in rows) for i, k, d in rows}
    assert {r.id: r["rank"] for r in ranked.collect()} == expected
    summed = blocks.over_key(df, ["k"], F.count("*").alias("n"))
    assert {(r.k, r.n) for r in summed.collect()} == {(None, 20), ("hot", 40)} and summed.count() == 60
