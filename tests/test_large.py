"""Faults that showed on large tables only, on small rows of the same form."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark import registry
from tidemark.graph import algorithms
from tidemark.graph.graph import Graph, pregel


def written(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_minhash_leaves_texts_without_words(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, words), (2, words + " lambda"), (3, "a b 12"), (4, ""), (5, "x"), (6, words), (7, "other words stand here")]
    written(spark.createDataFrame(rows, "doc_id bigint, text string"), tmp_path, "documents")
    found = registry.queries()["ft29_minhash_lsh"](spark, str(tmp_path)).collect()
    assert [(r.a, r.a_copies, r.b, r.b_copies, round(r.distance, 9)) for r in found] == [(1, 2, 2, 1, round(1 / 11, 9))]


def test_all_pairs_by_classes(spark):
    rng = random.Random(7)
    for n, m in ((30, 36), (25, 20)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(4)] + [(103, 101), (None, 3), (5, None)]
        edges = spark.createDataFrame(links + links[:3], "src bigint, dst bigint")
        want = set(links)
        while more := {(a, d) for a, b in want for c, d in links if b is not None and b == c} - want:
            want |= more
        got = [tuple(r) for r in algorithms.all_pairs(edges).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pregel_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chain = spark.range(9).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).mapInArrow(count, "src bigint, dst bigint")
    found = pregel(Graph(spark.range(10).select("id"), chain), F.col("id"), F.least, lambda s, d: F.when(s < d, s), F.min)
    assert {r.state for r in found.collect()} == {0} and made.value == 9
