"""Sources, streams, linear algebra, plans."""

from __future__ import annotations

import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.lineage.metrics import event_log_metrics
from tidemark.ml import linalg, training
from tidemark.session import scratch, shared_root
from tidemark.sources.jdbc import bound_predicates
from tidemark.streaming.runner import file_stream, run_complete


@pytest.mark.parametrize("low, high, parts", [(0, 100, 7), (0, 3, 10), (5, 6, 4), (-10, 10, 2)])
def test_bound_predicates_cover_all_rows_once(spark, low, high, parts):
    df = spark.range(low - 20, high + 20).toDF("x").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    counts = [df.where(p).count() for p in bound_predicates("x", low, high, parts)]
    assert sum(counts) == df.count()


def test_scratch_is_below_the_named_folder(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch(spark, "x").startswith(shared_root(spark) + "/x-")


def test_stream_equals_batch(tables):
    stream = run_complete(file_stream(tables, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("m")))
    batch = tables.events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("m"))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_gramian_and_correlation(spark):
    x = np.random.default_rng(1).normal(size=(200, 5))
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(6)
    assert np.allclose(linalg.dense(linalg.gramian(df, "v"), 5), x.T @ x)
    assert np.allclose(linalg.dense(linalg.correlation(df, "v"), 5), np.corrcoef(x.T))
    values, vectors = linalg.svd(df, "v", 5, 3)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:3])
    assert np.allclose(np.abs(vectors.T @ vectors), np.eye(3), atol=1e-9)


def test_streaming_k_means_sums(spark):
    x = np.random.default_rng(2).normal(size=(300, 4))
    centres = x[:3].copy()
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(5)
    model = training.StreamingKMeans(centres.copy())
    model.update(df, 0, "v")
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(model.centres, [x[near == i].mean(0) for i in range(3)])


def test_gradient_descent_separates(spark):
    df = spark.range(400).select((F.col("id") / 200 - 1).alias("x")).withColumn("y", (F.col("x") > 0.2).cast("double"))
    weights, sizes = training.logistic_gradient_descent(df, "y", ["x"], 60, 4.0)
    assert weights[1] > 3 and sizes[-1] < sizes[0]


def test_event_log(spark, tmp_path):
    """A job that logs its events runs in its own process; the log is read here."""
    script = textwrap.dedent(f"""
        from tidemark.session import local_session
        spark = local_session(2, "logged", **{{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{tmp_path}"}})
        spark.range(1000).repartition(3).write.format("noop").mode("overwrite").save()
        spark.stop()
    """)
    subprocess.run([sys.executable, "-c", script], check=True, timeout=180, cwd=str(__import__("pathlib").Path(__file__).parents[1]), capture_output=True)
    tasks = event_log_metrics(spark, str(tmp_path))
    assert tasks.agg(F.sum("shuffle_write_records")).first()[0] == 1000
    assert tasks.agg(F.sum("shuffle_read_records")).first()[0] == 1000
    assert tasks.where("run_ms < 0").isEmpty()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_cut_before_the_shuffle(spark):
    text = plan(registry.queries()["wi20_top_n"](spark, "/root/testdata/sf0.001"))
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.queries()["so09_filter_by_range"](spark, "/root/testdata/sf0.001"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice,100000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_flagship_reads_only_what_it_needs(spark):
    text = plan(registry.queries()["ln44_slowest_inputs"](spark, "/root/testdata/sf0.001"))
    assert text.count("FileScan") == 4 and "l_shipdate" not in text and "l_comment" not in text
    assert "Python" not in text and "CartesianProduct" not in text


PAIRED = {"jo07_cross", "jo22_cartesian"}  # the operator itself, with a checked small side


def test_no_query_pairs_all_rows(spark):
    lazy = ("ag", "jo0", "jo1", "wi0", "se", "pr", "ev0")
    for name, q in registry.queries().items():
        if name.startswith(lazy) and q.sql and name not in PAIRED:
            text = plan(q(spark, "/root/testdata/sf0.001"))
            assert "CartesianProduct" not in text, name


def test_itemsets_and_rules_of_all_sizes(spark, tables):
    import itertools

    baskets: dict = {}
    for r in tables.orders.collect():
        baskets.setdefault(r.o_custkey, set()).add(int(r.o_orderpriority[0]) * 10 + ord(r.o_orderstatus) % 10)
    items = sorted(set().union(*baskets.values()))
    sets, size = {}, 1
    while True:
        counted = {c: sum(set(c) <= b for b in baskets.values()) for c in itertools.combinations(items, size)}
        frequent = {c: n for c, n in counted.items() if n >= 0.2 * len(baskets)}
        if not frequent:
            break
        sets |= frequent
        size += 1
    assert size > 3  # sets of three items at least
    found = registry.queries()["mo25_fp_growth_itemsets"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(sets) and {tuple(r["items"]): r.n for r in found} == sets
    rules = {(tuple(x for x in c if x != i), i): n / sets[tuple(x for x in c if x != i)] for c, n in sets.items() if len(c) > 1 for i in c}
    rules = {k: v for k, v in rules.items() if v >= 0.5}
    found = registry.queries()["mo26_association_rules_itemsets"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(rules) and all(abs(rules[tuple(r.antecedent), r.consequent] - r.confidence) < 1e-12 for r in found)


def test_count_vectorizer_keeps_all_words(spark, tmp_path):
    from collections import Counter

    rows = [(k, " ".join([*(f"w{10 * k + j}" for j in range(10)), "all", "all"])) for k in range(1_050)]  # 10,501 words
    spark.createDataFrame(rows, "p_partkey bigint, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    found = registry.queries()["ft22_count_vectorizer"](spark, str(tmp_path)).collect()
    want = {(k, w): float(n) for k, name in rows for w, n in Counter(name.split(" ")).items()}
    assert len(found) == len(want) and {(r.p_partkey, r.word): r.n for r in found} == want


def test_lda_sees_all_words(spark, tables, monkeypatch):
    import re

    from pyspark.ml import clustering

    sizes, fit = [], clustering.LDA.fit

    def seen(self, df, *args):
        sizes.append(df.first()["features"].size)
        return fit(self, df, *args)

    monkeypatch.setattr(clustering.LDA, "fit", seen)
    assert registry.queries()["mo20_lda"](spark, "/root/testdata/sf0.001").count() == tables.documents.count()
    assert sizes == [len({w for r in tables.documents.collect() for w in re.findall("[a-z]+", r.text.lower()) if len(w) >= 3})]


def test_svd_plus_plus_gives_users_and_items(spark, tables):
    found = registry.queries()["gx24_svd_plus_plus"](spark, "/root/testdata/sf0.001")
    bought = tables.lineitem.join(tables.orders, F.expr("l_orderkey = o_orderkey"))
    kinds = {r.kind: r for r in found.groupBy("kind").agg(F.count("*").alias("n"), F.count("f3").alias("f"), F.count("y3").alias("y")).collect()}
    users, items = bought.select("o_custkey").distinct().count(), bought.select("l_partkey").distinct().count()
    assert (kinds["user"].n, kinds["user"].f, kinds["item"].n, kinds["item"].f, kinds["item"].y) == (users, users, items, items, items)


def test_weeks_of_two_years_are_two_sequences(spark, tmp_path):
    rows = [(1, "2023-01-03 10:00:00", "a"), (1, "2024-01-03 10:00:00", "b")]
    made = spark.createDataFrame(rows, "user_id bigint, ts string, event_type string").withColumn("ts", F.to_timestamp_ntz("ts"))
    made.write.parquet(str(tmp_path / "events.parquet"))
    found = registry.queries()["mo27_prefix_span"](spark, str(tmp_path)).collect()
    assert sorted(r.sequence for r in found) == [[["a"]], [["b"]]]
