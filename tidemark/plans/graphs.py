"""Graphs of customers linked by consecutive orders of equal priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.graph import algorithms as A
from tidemark.graph.graph import Graph, pregel
from tidemark.registry import query
from tidemark.session import scratch

PAIRS = """SELECT a.o_custkey AS src, b.o_custkey AS dst, b.o_totalprice AS w, a.o_orderpriority AS p
    FROM orders AS a JOIN orders AS b ON b.o_orderkey = a.o_orderkey + 1 AND b.o_orderpriority = a.o_orderpriority"""
URGENT = f"SELECT src, dst, w FROM ({PAIRS}) WHERE p = '1-URGENT'"
WITH_E = f"e AS MATERIALIZED (SELECT src, dst, w FROM ({PAIRS}))"
WITH_U = f"e AS MATERIALIZED ({URGENT})"
VERTS = "v AS MATERIALIZED (SELECT c_custkey AS id, c_acctbal AS bal FROM customer)"


def pairs(t):
    # an equi-join on the unique order key
    a = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("o_orderpriority").alias("p"))
    b = t.orders.select(F.col("o_custkey").alias("dst"), "o_orderkey", F.col("o_totalprice").alias("w"), F.col("o_orderpriority").alias("_p"))
    return a.join(b, "o_orderkey").where("p = _p").select("src", "dst", "w", "p")


def vertices(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))


def links(t) -> Graph:
    return Graph(vertices(t), pairs(t).select("src", "dst", "w"))


def urgent(t) -> Graph:
    """A sparse graph with many components."""
    return Graph(vertices(t), pairs(t).where("p = '1-URGENT'").select("src", "dst", "w"))


@query("gx01_edge_list", f"""
    SELECT 'edges' AS what, count(*) AS n FROM ({PAIRS}) UNION ALL
    SELECT 'vertices', count(*) FROM (SELECT src FROM ({PAIRS}) UNION SELECT dst FROM ({PAIRS})) UNION ALL
    SELECT 'canonical', count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM ({PAIRS}))""")
def _(t):
    path = scratch(t.spark, "edges")
    pairs(t).select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
    lines = t.spark.read.text(path)
    graph, canonical = Graph.from_edge_list(lines), Graph.from_edge_list(lines, canonical=True)
    n = F.count("*").alias("n")
    return graph.edges.agg(F.lit("edges").alias("what"), n).union(graph.vertices.agg(F.lit("vertices"), n)).union(
        canonical.edges.distinct().agg(F.lit("canonical"), n))


@query("gx02_from_edges", f"SELECT src AS id FROM ({PAIRS}) UNION SELECT dst FROM ({PAIRS})")
def _(t):
    return Graph.from_edges(pairs(t)).vertices


@query("gx03_map_vertices", "SELECT c_custkey AS id, c_acctbal AS bal, round(c_acctbal / 2, 4) AS half FROM customer")
def _(t):
    return links(t).map_vertices(half=F.round(F.col("bal") / 2, 4)).vertices


@query("gx04_map_edges", f"SELECT src, dst, w, w > 250000 AS large FROM ({PAIRS})")
def _(t):
    return links(t).map_edges(large=F.col("w") > 250000).edges


@query("gx05_reverse", f"SELECT dst AS src, src AS dst, w FROM ({PAIRS})")
def _(t):
    return links(t).reverse().edges


SUB = f"""SELECT src, dst, w FROM ({PAIRS}) WHERE w > 100000 AND src IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)
    AND dst IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)"""


def sub(t):
    return links(t).subgraph(F.col("w") > 100000, F.col("bal") > 2000)


@query("gx06_subgraph", SUB)
def _(t):
    return sub(t).edges.select("src", "dst", "w")


@query("gx07_edge_inner_join", f"""
    SELECT e.src, e.dst, e.w, u.n FROM ({PAIRS}) AS e JOIN (SELECT src, dst, count(*) AS n FROM ({URGENT}) GROUP BY 1, 2) AS u USING (src, dst)""")
def _(t):
    counted = urgent(t).edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return links(t).inner_join_edges(counted).select("src", "dst", "w", "n")


@query("gx07_mask", f"SELECT src, dst, w FROM ({PAIRS}) WHERE (src, dst) IN (SELECT src, dst FROM ({SUB}))")
def _(t):
    return links(t).mask(sub(t)).edges.select("src", "dst", "w")


@query("gx08_vertex_minus", f"SELECT c_custkey AS id, c_acctbal AS bal FROM customer WHERE c_custkey NOT IN (SELECT src FROM ({URGENT}))")
def _(t):
    return links(t).minus(urgent(t).edges.select(F.col("src").alias("id")))


@query("gx09_vertex_diff", "SELECT c_custkey AS id, greatest(c_acctbal, 3000) AS bal FROM customer WHERE c_acctbal < 3000")
def _(t):
    raised = vertices(t).select("id", F.greatest("bal", F.lit(3000.0)).alias("bal"))
    return links(t).diff(raised, "bal")


@query("gx10_vertex_joins", """
    SELECT 'left' AS kind, c_custkey AS id, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey
    UNION ALL SELECT 'inner', c_custkey, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    pending = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    g = links(t)
    return g.join_vertices(pending).vertices.select(F.lit("left").alias("kind"), "id", "n").union(
        g.join_vertices(pending, "inner").vertices.select(F.lit("inner"), "id", "n"))


@query("gx11_aggregate_using_index", "SELECT o_custkey AS id, max(o_totalprice) AS top, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("top"), F.count("*").alias("n"))


@query("gx12_triplets", f"SELECT src, dst, w, s.c_acctbal AS a, d.c_acctbal AS b FROM ({PAIRS}) JOIN customer AS s ON s.c_custkey = src JOIN customer AS d ON d.c_custkey = dst")
def _(t):
    return links(t).triplets().select("src", "dst", "w", F.col("s.bal").alias("a"), F.col("d.bal").alias("b"))


@query("gx13_aggregate_messages", f"""
    SELECT id, count(*) AS n, max(m) AS top FROM (SELECT dst AS id, s.c_acctbal AS m FROM ({PAIRS}) JOIN customer AS s ON s.c_custkey = src
        UNION ALL SELECT src, d.c_acctbal FROM ({PAIRS}) JOIN customer AS d ON d.c_custkey = dst) GROUP BY 1""")
def _(t):
    got = links(t).aggregate_messages(
        lambda m: F.struct(F.count("*").alias("n"), F.max(m).alias("top")), to_dst=F.col("s.bal"), to_src=F.col("d.bal"))
    return got.select("id", "message.n", "message.top")


@query("gx14_degrees", f"""
    SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
        SELECT src AS id, 0 AS i, 1 AS o FROM ({PAIRS}) UNION ALL SELECT dst, 1, 0 FROM ({PAIRS})) GROUP BY 1""")
def _(t):
    return links(t).degrees()


@query("gx14_neighbours", f"SELECT src AS id, dst AS neighbour FROM ({PAIRS}) WHERE src <> dst UNION SELECT dst, src FROM ({PAIRS}) WHERE src <> dst")
def _(t):
    return links(t).without_self_edges().neighbours("either")


@query("gx15_canonical_edges", f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS n, max(w) AS w FROM ({PAIRS}) GROUP BY 1, 2")
def _(t):
    return links(t).canonical_edges(F.count("*").alias("n"), F.max("w").alias("w")).edges


@query("gx15_group_edges", f"SELECT src, dst, count(*) AS n, round(sum(w), 2) AS w FROM ({PAIRS}) GROUP BY 1, 2")
def _(t):
    return links(t).group_edges(F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("w")).edges


def rounds(n: int, first: str, step: str, last: str, edges: str = WITH_E) -> str:
    """WITH r0 AS (first), r1 AS (step over r0), .. : ``{r}`` is the round before."""
    parts = [VERTS, edges, f"r0 AS MATERIALIZED ({first})"]
    parts += [f"r{i + 1} AS MATERIALIZED ({step.format(r=f'r{i}')})" for i in range(n)]
    return f"WITH {', '.join(parts)} {last.format(r=f'r{n}')}"


SPREAD = "SELECT id, max(x) AS x FROM (SELECT id, x FROM {r} UNION ALL SELECT dst, x FROM e JOIN {r} ON id = src) GROUP BY 1"


@query("gx16_pregel_urgent", rounds(30, "SELECT id, bal AS x FROM v", SPREAD, "SELECT id, x AS state FROM {r}", WITH_U))
def _(t):
    """The largest balance on any path into a vertex."""
    return pregel(urgent(t), F.col("bal"), F.greatest, lambda s, d: F.when(s > d, s), F.max)


REACHED = f"""WITH RECURSIVE {VERTS}, {WITH_E}, r(id, x) AS (SELECT id, id FROM v UNION SELECT dst, x FROM r JOIN e ON src = id) """


@query("gx16_pregel", f"{REACHED} SELECT r.id, max(bal) AS state FROM r JOIN v ON v.id = x GROUP BY 1")
def _(t):
    """The same over the links of all priorities; paths are as long as they get."""
    return pregel(links(t), F.col("bal"), F.greatest, lambda s, d: F.when(s > d, s), F.max)


RANK = """SELECT v.id, {reset} + 0.85 * coalesce(s, 0) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank / deg) AS s FROM e
    JOIN {{r}} ON {{r}}.id = src JOIN (SELECT src AS k, count(*) AS deg FROM e GROUP BY 1) ON k = src GROUP BY 1) ON dst = v.id"""


@query("gx17_page_rank", rounds(6, "SELECT id, 1.0::DOUBLE AS rank FROM v", RANK.format(reset="0.15"), "SELECT id, round(rank, 9) AS rank FROM {r}"))
def _(t):
    return A.page_rank(links(t), 6).withColumn("rank", F.round("rank", 9))


@query("gx17_page_rank_until")
def _(t):
    return A.page_rank_until(links(t), 0.001)


PERSONAL = "CASE WHEN v.id = 1 THEN 0.15 ELSE 0 END"


@query("gx17_page_rank_personalized", rounds(
    6, "SELECT id, CASE WHEN id = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS rank FROM v", RANK.format(reset=PERSONAL), "SELECT id, round(rank, 9)::DOUBLE AS rank FROM {r}"))
def _(t):
    return A.page_rank(links(t), 6, source=1).withColumn("rank", F.round("rank", 9))


REACH = f"""WITH RECURSIVE {VERTS}, {WITH_U}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    r(id, x) AS (SELECT id, id FROM v UNION SELECT dst, x FROM r JOIN b ON src = id) """


@query("gx18_connected_components_urgent", f"{REACH} SELECT id, min(x) AS component FROM r GROUP BY 1")
def _(t):
    return A.connected_components(urgent(t))


@query("gx18_connected_components", f"""
    WITH RECURSIVE {VERTS}, {WITH_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    r(id, x) AS (SELECT id, id FROM v UNION SELECT dst, x FROM r JOIN b ON src = id) SELECT id, min(x) AS component FROM r GROUP BY 1""")
def _(t):
    return A.connected_components(links(t))


@query("gx19_strongly_connected_components_urgent", f"""
    WITH RECURSIVE {VERTS}, {WITH_U}, r(id, x) AS (SELECT id, id FROM v UNION SELECT dst, x FROM r JOIN e ON src = id)
    SELECT a.id, min(a.x) AS component FROM r AS a JOIN r AS b ON a.id = b.x AND a.x = b.id GROUP BY 1""")
def _(t):
    return A.strongly_connected_components(urgent(t))


@query("gx19_strongly_connected_components", f"{REACHED} SELECT a.id, min(a.x) AS component FROM r AS a JOIN r AS b ON a.id = b.x AND a.x = b.id GROUP BY 1")
def _(t):
    return A.strongly_connected_components(links(t))


@query("gx20_triangle_count", f"""
    WITH {VERTS}, c AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({PAIRS}) WHERE src <> dst),
    t AS (SELECT x.a, x.b, y.b AS c FROM c AS x JOIN c AS y ON y.a = x.b JOIN c AS z ON z.a = x.a AND z.b = y.b)
    SELECT v.id, coalesce(n, 0) AS triangles FROM v LEFT JOIN (
        SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1) AS k ON k.id = v.id""")
def _(t):
    return A.triangle_count(links(t))


LABEL = """SELECT v.id, coalesce(b.label, {r}.label) AS label FROM v JOIN {r} ON {r}.id = v.id LEFT JOIN (
    SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS n FROM (
        SELECT dst AS id, label FROM e JOIN {r} ON {r}.id = src UNION ALL SELECT src, label FROM e JOIN {r} ON {r}.id = dst) GROUP BY 1, 2) WHERE n = 1) AS b ON b.id = v.id"""


@query("gx21_label_propagation", rounds(4, "SELECT id, id AS label FROM v", LABEL, "SELECT id, label FROM {r}"))
def _(t):
    return A.label_propagation(links(t), 4)


@query("gx22_shortest_paths", f"""
    WITH RECURSIVE {VERTS}, {WITH_E}, m AS (SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3),
    r(id, landmark, hops) AS (SELECT id, id, 0 FROM m UNION SELECT src, landmark, hops + 1 FROM r JOIN e ON dst = r.id WHERE hops < 25)
    SELECT id, landmark, min(hops) AS hops FROM r GROUP BY 1, 2""")
def _(t):
    richest = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(3).select(F.col("c_custkey").alias("id"))
    return A.shortest_hops(links(t), richest)


DISTANCE = "SELECT id, min(x) AS x FROM (SELECT id, x FROM {r} UNION ALL SELECT dst, x + w FROM e JOIN {r} ON id = src) GROUP BY 1"


@query("gx23_weighted_shortest_path", rounds(
    25, "SELECT id, CASE WHEN id = 1 THEN 0 ELSE 'inf'::DOUBLE END AS x FROM v", DISTANCE, "SELECT id, round(x, 2) AS distance FROM {r} WHERE x < 'inf'::DOUBLE"))
def _(t):
    found = A.shortest_distance(links(t), 1, "w")
    return found.where(F.col("state") < float("inf")).select("id", F.round("state", 2).alias("distance"))


@query("gx24_svd_plus_plus")
def _(t):
    bought = t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey")).groupBy(
        F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg((F.avg("l_quantity") / 10).alias("rating"))
    users, items, mean = A.svd_plus_plus(bought)
    factors, none = range(4), F.lit(None).cast("double")
    of_users = users.select(F.lit("user").alias("kind"), F.col("user").alias("id"), F.col("pb").alias("bias"), *[F.col(f"p{j}").alias(f"f{j}") for j in factors], *[none.alias(f"y{j}") for j in factors])
    of_items = items.select(F.lit("item").alias("kind"), F.col("item").alias("id"), F.col("qb").alias("bias"), *[F.col(f"q{j}").alias(f"f{j}") for j in factors], *[f"y{j}" for j in factors])
    return of_users.union(of_items).withColumn("mean", F.lit(mean))


@query("gx26_transitive_closure", f"WITH RECURSIVE {WITH_U}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r")
def _(t):
    return A.transitive_closure(urgent(t).edges)


@query("gx26_transitive_closure_all_links")
def _(t):
    """The result has up to the square of the customers' number of rows: nearly all customers are linked."""
    return A.all_pairs(links(t).edges)


@query("gx26_closure_classes", f"""
    WITH RECURSIVE {VERTS}, {WITH_E}, p(src, dst) AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON e.src = p.dst),
    c AS (SELECT v.id, least(v.id, coalesce(min(b.dst), v.id)) AS component FROM v LEFT JOIN (
        SELECT x.src, x.dst FROM p AS x JOIN p AS y ON x.src = y.dst AND x.dst = y.src) AS b ON b.src = v.id GROUP BY v.id)
    SELECT DISTINCT x.component AS src, y.component AS dst FROM p JOIN c AS x ON x.id = p.src JOIN c AS y ON y.id = p.dst""")
def _(t):
    """Paths between classes of customers that reach one another, over all links; ``gx19_strongly_connected_components`` has the members."""
    return A.class_closure(links(t))[1]


@query("gx27_star", "SELECT c_custkey AS src, 0::BIGINT AS dst FROM customer WHERE c_custkey > 0")
def _(t):
    return A.star(vertices(t).select("id"))


@query("gx27_grid", """
    SELECT r * n + s_suppkey AS src, r * n + s_suppkey + 1 AS dst FROM supplier, (SELECT count(*) AS n FROM supplier), (SELECT unnest(range(4)) AS r) WHERE s_suppkey + 1 < n
    UNION ALL SELECT r * n + s_suppkey, (r + 1) * n + s_suppkey FROM supplier, (SELECT count(*) AS n FROM supplier), (SELECT unnest(range(3)) AS r)""")
def _(t):
    return A.grid(4, t.supplier.select(F.col("s_suppkey").alias("id")))


@query("gx27_log_normal")
def _(t):
    return A.log_normal_edges(vertices(t).select("id"), 1.0, 0.8, seed=4)


@query("gx27_rmat")
def _(t):
    return A.rmat_edges(t.orders.select(F.col("o_orderkey").alias("id")), 10, seed=8)
