"""Graph algorithms against plain Python on random graphs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.graph import algorithms as A
from tidemark.graph.graph import Graph


def make(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    graph = Graph(spark.range(n).select("id"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    return graph, edges


def reach(n, edges):
    out = {i: {i} for i in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for s in out.values():
                if a in s and b not in s:
                    s.add(b)
                    changed = True
    return out


@pytest.mark.parametrize("n, m, seed", [(40, 25, 1), (30, 45, 2)])
def test_components(spark, n, m, seed):
    graph, edges = make(spark, n, m, seed)
    both = reach(n, edges + [(b, a) for a, b in edges])
    assert {r.id: r.component for r in A.connected_components(graph).collect()} == {i: min(s) for i, s in both.items()}
    one_way = reach(n, edges)
    strong = {i: min(j for j in range(n) if j in one_way[i] and i in one_way[j]) for i in range(n)}
    assert {r.id: r.component for r in A.strongly_connected_components(graph).collect()} == strong


def test_long_chain_is_one_component(spark):
    chain = Graph(spark.range(200).select("id"), spark.range(199).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert {r.component for r in A.connected_components(chain).collect()} == {0}


def test_triangles_with_a_hub(spark):
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 30)] + [(rng.randrange(1, 30), rng.randrange(1, 30)) for _ in range(60)]
    graph = Graph(spark.range(30).select("id"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    links = {frozenset(e) for e in edges if e[0] != e[1]}
    want = dict.fromkeys(range(30), 0)
    for t in itertools.combinations(range(30), 3):
        if all(frozenset(p) in links for p in itertools.combinations(t, 2)):
            for v in t:
                want[v] += 1
    assert {r.id: r.triangles for r in A.triangle_count(graph).collect()} == want


def test_page_rank_until_is_the_fixed_point(spark):
    graph, edges = make(spark, 20, 60, 3)
    got = {r.id: r["rank"] for r in A.page_rank_until(graph, 1e-6).collect()}
    out = {i: sum(a == i for a, _ in edges) for i in range(20)}
    rank = np.ones(20)
    for _ in range(300):
        new = np.full(20, 0.15)
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    assert max(abs(got[i] - rank[i]) for i in range(20)) < 1e-4


def test_hops_and_closure(spark):
    graph, edges = make(spark, 25, 40, 8)
    want = reach(25, edges)
    hops = {(r.id, r.landmark): r.hops for r in A.shortest_hops(graph, spark.createDataFrame([(0,), (3,)], "id bigint")).collect()}
    assert set(hops) == {(i, m) for i in range(25) for m in (0, 3) if m in want[i]}
    closure = {(r.src, r.dst) for r in A.transitive_closure(graph.edges).collect()}
    step = {a: {b for x, b in edges if x == a} for a in range(25)}
    assert closure == {(a, d) for a in range(25) for b in step[a] for d in want[b]}


def test_svd_plus_plus_lowers_the_error(spark):
    rng = random.Random(4)
    rows = [(u, i, (u % 3) + (i % 2) + rng.random() * 0.1) for u in range(12) for i in range(10) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "user int, item int, rating double")

    def error(rounds):
        users, items, mean = A.svd_plus_plus(df, rounds=rounds, gamma=0.5)
        bu, bi = {r.user: r.pb for r in users.collect()}, {r.item: r.qb for r in items.collect()}
        return sum((x - mean - bu[u] - bi[i]) ** 2 for u, i, x in rows)

    assert error(6) < 0.6 * error(0)


def test_edge_list_text(spark):
    lines = spark.createDataFrame([("# comment",), ("1 2",), ("2\t1",), (" 3  1 ",), ("",)], "value string")
    graph = Graph.from_edge_list(lines)
    assert sorted((r.src, r.dst) for r in graph.edges.collect()) == [(1, 2), (2, 1), (3, 1)]
    assert sorted(r.id for r in graph.vertices.collect()) == [1, 2, 3]


def test_loops_end_by_themselves_or_raise(spark):
    path = Graph(spark.range(21).toDF("id"), spark.range(20).selectExpr("id AS src", "id + 1 AS dst"))
    assert A.strongly_connected_components(path).count() == 21
    with pytest.raises(RuntimeError):
        A.shortest_hops(path, spark.range(20, 21).toDF("id"), max_rounds=3)
    with pytest.raises(RuntimeError):
        A.transitive_closure(path.edges, max_rounds=3)
    with pytest.raises(RuntimeError):
        A.strongly_connected_components(path, max_rounds=3)


def test_links_of_all_priorities(spark, tables):
    from tidemark import registry

    queries, path = registry.queries(), "/root/testdata/sf0.001"
    orders = {r.o_orderkey: (r.o_custkey, r.o_orderpriority) for r in tables.orders.collect()}
    pairs = [(a, orders[k + 1][0], p) for k, (a, p) in orders.items() if k + 1 in orders and orders[k + 1][1] == p]
    balance = {r.c_custkey: r.c_acctbal for r in tables.customer.collect()}
    assert any(p != "1-URGENT" for _, _, p in pairs)

    def reached(edges):
        out = {i: {i} for i in balance}
        for i in out:
            front = [i]
            while front:
                front = [b for x in front for b in edges.get(x, ()) if not (b in out[i] or out[i].add(b))]
        return out

    one_way, both = {}, {}
    for a, b, _ in pairs:
        one_way.setdefault(a, set()).add(b)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    to, near = reached(one_way), reached(both)
    state = {i: max(balance[j] for j in balance if i in to[j]) for i in balance}
    assert {r.id: r.state for r in queries["gx16_pregel"](spark, path).collect()} == state
    assert {r.id: r.component for r in queries["gx18_connected_components"](spark, path).collect()} == {i: min(x) for i, x in near.items()}
    strong = {i: min(j for j in to[i] if i in to[j]) for i in balance}
    assert {r.id: r.component for r in queries["gx19_strongly_connected_components"](spark, path).collect()} == strong
    closure = {(r.src, r.dst) for r in queries["gx26_transitive_closure_all_links"](spark, path).collect()}
    assert closure == {(a, d) for a in one_way for b in one_way[a] for d in to[b]}
