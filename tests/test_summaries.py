"""Quantile summaries, near vectors, NOT IN, streaming models that survive, and closures by classes."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.graph import algorithms as A
from tidemark.graph.graph import Graph
from tidemark.lineage import latency
from tidemark.ml import streaming
from tidemark.operators import neighbours, quantiles
from tidemark.operators.antijoin import not_in
from tidemark.operators.sketches import BloomFilter
from tidemark.session import scratch, setting
from tidemark.tables import Tables


def rank_error(values, wanted_share, found):
    values = np.sort(values)
    rank = max(1, math.ceil(wanted_share * len(values)))
    low, high = np.searchsorted(values, found, "left") + 1, np.searchsorted(values, found, "right")
    return max(0, low - rank, rank - high)


COLUMNS = {
    "random": lambda rng, n: rng.standard_normal(n), "sorted": lambda rng, n: np.arange(n) / 7, "reversed": lambda rng, n: -np.arange(n) / 7,
    "constant": lambda rng, n: np.full(n, 3.5), "ties": lambda rng, n: rng.integers(0, 5, n).astype(float), "skewed": lambda rng, n: rng.pareto(0.5, n)}


@pytest.mark.parametrize("kind", COLUMNS)
def test_merged_summaries_keep_the_error(kind):
    rng = np.random.default_rng(4)
    error = 0.02
    share = error / (quantiles.LEVELS + 1)
    parts = [COLUMNS[kind](rng, int(rng.integers(1, 9000))) for _ in range(20)]
    nodes = [quantiles.pruned(quantiles.summary_of(p), share) for p in parts]
    while len(nodes) > 1:
        level = []
        for i in range(0, len(nodes), 4):
            whole = nodes[i]
            for other in nodes[i + 1:i + 4]:
                whole = quantiles.merged(whole, other)
            level.append(quantiles.pruned(whole, share))
        nodes = level
    values, least, most, n = nodes[0]
    together = np.concatenate(parts)
    assert n == len(together) and len(values) <= 2 / share + 2
    ordered = np.sort(together)
    # the bounds hold for every entry
    assert (least <= np.searchsorted(ordered, values, "right")).all() and (most >= np.searchsorted(ordered, values, "left") + 1).all()
    for s in np.linspace(0, 1, 41):
        rank = max(1, math.ceil(s * n))
        found = values[np.argmin(np.maximum(rank - least, most - rank))]
        assert rank_error(together, s, found) <= error * n


def test_summaries_over_tasks(spark):
    rng = np.random.default_rng(5)
    values = rng.standard_normal(20_000)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(37)
    summary = quantiles.summarised(df, "v", 0.05)
    found = {r["share"]: r["value"] for r in quantiles.quantiles_of(summary, [0.01, 0.5, 0.99]).collect()}
    assert all(rank_error(values, s, v) <= 0.05 * 20_000 for s, v in found.items()) and len(found) == 3
    assert quantiles.quantiles_of(quantiles.summarised(df.limit(0), "v", 0.05), [0.5]).count() == 0


def test_exact_quantiles_by_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 2.0, 5.0, rng.random()])) for _ in range(500)] + [("c", 9.0), ("a", None)]
    found = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", [0.0, 0.25, 0.5, 1.0], ["g"]).collect()
    wanted = {}
    for g in ("a", "b", None, "c"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        wanted |= {(g, s): own[max(1, math.ceil(s * len(own))) - 1] for s in (0.0, 0.25, 0.5, 1.0)}
    assert {(r["g"], r["share"]): r["value"] for r in found} == wanted and len(found) == len(wanted)


def vectors_of(spark):
    rows = Tables(spark, "/root/testdata/sf0.01").embeddings.select("vec_id", "embedding").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)


def test_recall_of_near_pairs(spark):
    ids, v = vectors_of(spark)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    wanted = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i) if d[i, j] <= 1.1}
    found = neighbours.near_pairs(Tables(spark, "/root/testdata/sf0.01").embeddings, "vec_id", "embedding", 1.1, recall=0.97).collect()
    pairs = {(r["a"], r["b"]) for r in found}
    assert pairs <= wanted and len(pairs) == len(found) and len(pairs) >= 0.9 * len(wanted) > 0


def test_recall_of_nearest(spark):
    ids, v = vectors_of(spark)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    table = Tables(spark, "/root/testdata/sf0.01").embeddings
    found = neighbours.nearest(table, "vec_id", "embedding", table.where("vec_id % 20 = 0"), "vec_id", "embedding", 11, reach=1.2).collect()
    by_query: dict = {}
    for r in found:
        by_query.setdefault(r["query"], set()).add(r["key"])
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        best = {ids[j] for j in np.argsort(d[ids.index(q)], kind="stable")[:11]}
        hits, total = hits + len(best & by_query[q]), total + 11
    assert hits >= 0.9 * total and len(by_query) == len([i for i in ids if i % 20 == 0])


def test_chances_are_those_of_made_up_neighbours():
    index = neighbours.Index.planned(16, 1.0, 0.9, directions=3, probes=6)
    rng = np.random.default_rng(3)
    a = rng.standard_normal((3000, 16)) * 5
    step = rng.standard_normal((3000, 16))
    b = a + step / np.linalg.norm(step, axis=1)[:, None]
    at, there = index.cells(a), np.floor(index.cells(b)).astype(np.int64)
    own = np.floor(at).astype(np.int64)
    steps = neighbours.probe_order((at - own).reshape(-1, 3), 6).reshape(3000, -1, 6, 3)
    met = ((own[:, :, None] + steps) == there[:, :, None]).all(axis=3).any(axis=(1, 2)).mean()
    assert met > 0.87
    assert neighbours.chance(0.01, 2.0, 3, 1) > neighbours.chance(1.0, 2.0, 3, 1)


def test_near_pairs_of_few_rows(spark):
    schema = "id int, v array<float>, a int, cell string"
    rows = [(1, [0.0, 1.0], 5, "x"), (2, [0.0, 1.1], 5, "x"), (3, None, 5, "x"), (4, [9.0, 9.0], 5, "x")]
    found = neighbours.near_pairs(spark.createDataFrame(rows, schema), "id", "v", 0.5, 0.999).collect()
    assert [(r["a"], r["b"]) for r in found] == [(1, 2)]
    assert neighbours.near_pairs(spark.createDataFrame([], schema), "id", "v", 0.5).count() == 0


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], "v int")
    for values, kept in (([1, 1, 3], [2, 2]), ([1, None], []), ([], [1, 2, 2, None]), ([None], []), ([7], [1, 2, 2])):
        right = spark.createDataFrame([(x,) for x in values], "v int")
        left.createOrReplaceTempView("l"), right.createOrReplaceTempView("r")
        found = [r["v"] for r in not_in(left, "v", right, "v").collect()]
        assert sorted(found, key=str) == sorted(kept, key=str) == sorted([r["v"] for r in spark.sql("SELECT v FROM l WHERE v NOT IN (SELECT v FROM r)").collect()], key=str)


def test_not_in_does_not_broadcast_the_values(spark, tables):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = not_in(tables.part, "p_size", tables.lineitem, "l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_bloom_filter_joins_and_takes_nulls(spark):
    keys = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "k int")
    bloom = BloomFilter.build(keys, "k", 201, 0.01)
    probe = spark.createDataFrame([(i, i) for i in range(1000)] + [(None, -1), (None, -2)], "k int, name int")
    tested = bloom.test(probe, "k", "maybe")
    rows = tested.collect()
    assert len(rows) == 1002 and all(r["maybe"] for r in rows if r["k"] is None or r["k"] < 200)
    assert sum(r["maybe"] for r in rows) < 202 + 60
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = bloom.test(probe, "k", "maybe")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Broadcast" not in plan


def test_impact_of_the_slowest(spark):
    state = spark.createDataFrame([(1, 5.0, 1.0, "a"), (2, 9.0, 2.0, "a"), (3, 4.0, 0.0, "b")], "id int, latency double, rm_latency double, slowest string")
    found = latency.impact_by_output(state)
    assert {(r["id"], r["impact"]) for r in found.collect()} == {(1, 7.0), (2, 7.0), (3, 4.0)}


# ---- streaming models -----------------------------------------------------------------------


def file_per_batch(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, "id int, y double, x double").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("id int, y double, x double").option("maxFilesPerTrigger", 1).parquet(path)


BATCHES = [[(100 * b + i, 2.0 * i / 10 + 1, i / 10) for i in range(10)] for b in range(3)]


def test_a_killed_batch_is_repeated_with_the_same_model(spark):
    step = streaming.linear_step("y", ["x"], 0.3)

    def run(fail_at):
        path, checkpoint, states = scratch(spark, "in"), scratch(spark, "cp"), streaming.States(spark, scratch(spark, "st"))
        file_per_batch(spark, path, BATCHES)
        states.start({"weights": [0.0, 0.0]})
        calls = []

        def failing(batch, parameters):
            calls.append(parameters)
            after = step(batch, parameters)
            if len(calls) == fail_at:  # after the work, before or while the model is written
                states.write(len(calls) - 1, -1, 0.0, {"weights": [99.0, 99.0]})
                raise RuntimeError("killed")
            return after

        if fail_at:
            with pytest.raises(Exception, match="killed"):
                streaming.train(stream(spark, path), states, failing, checkpoint)
        # another run with the same checkpoint, as after a restart; the start is not written again
        states.start({"weights": [7.0, 7.0]})
        streaming.train(stream(spark, path), states, step, checkpoint)
        return {r["batch"]: (r["n"], r["parameters"]) for r in states.history().collect()}

    whole = run(None)
    assert run(2) == whole and [whole[b][0] for b in range(3)] == [10, 10, 10]


def test_states_go_on_with_later_files_and_predict(spark):
    path, checkpoint, states = scratch(spark, "in"), scratch(spark, "cp"), streaming.States(spark, scratch(spark, "st"))
    states.start({"weights": [0.0, 0.0]})
    step, out = streaming.linear_step("y", ["x"], 0.3), scratch(spark, "out")
    file_per_batch(spark, path, BATCHES[:1])
    streaming.predict_on(stream(spark, path), states, step, checkpoint, out, "id", "y", ["x"])
    file_per_batch(spark, path, BATCHES[1:])
    found = streaming.predict_on(stream(spark, path), states, step, checkpoint, out, "id", "y", ["x"]).collect()
    assert len(found) == 30 and {r["prediction"] for r in found if r["batch"] == 0} == {0.0}
    error = {b: np.mean([abs(r["prediction"] - r["label"]) for r in found if r["batch"] == b]) for b in range(3)}
    assert error[2] < error[1] < error[0]
    w = states.before(2)["weights"]
    assert all(r["prediction"] == pytest.approx(w[0] + w[1] * (r["id"] % 100) / 10) for r in found if r["batch"] == 2)


def test_k_means_states(spark):
    path, states = scratch(spark, "in"), streaming.States(spark, scratch(spark, "st"))
    rng = np.random.default_rng(0)
    rows = [([float(x) for x in rng.standard_normal(2) * 0.1 + centre],) for centre in ([0, 0], [5, 5]) for _ in range(50)]
    spark.createDataFrame(rows, "v array<float>").coalesce(1).write.parquet(path)
    states.start({"centres": [[1.0, 1.0], [4.0, 4.0]], "weights": [0.0, 0.0]})
    streaming.train(spark.readStream.schema("v array<float>").parquet(path), states, streaming.k_means_step("v"), scratch(spark, "cp"))
    assert np.allclose(states.latest()["centres"], [[0, 0], [5, 5]], atol=0.1) and states.latest()["weights"] == [50.0, 50.0]


# ---- closure by classes ------------------------------------------------------------------------


def test_class_closure_equals_brute_force(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(24), rng.randrange(24)) for _ in range(26)] + [(30, 30), (31, 32)]
    graph = Graph(spark.createDataFrame([(i,) for i in range(34)], "id bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    members, paths = A.class_closure(graph)
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    component = {r["id"]: r["component"] for r in members.collect()}
    assert component == {i: min([i, *(j for j in range(34) if (i, j) in reach and (j, i) in reach)]) for i in range(34)}
    rows = paths.collect()
    assert {tuple(r) for r in rows} == {(component[a], component[b]) for a, b in reach} and len(rows) == len(set(map(tuple, rows)))
