"""Graph algorithms as rounds of joins and grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import random
from tidemark.graph.graph import Graph, pregel
from tidemark.session import shuffled_joins, shuffle_partitions, stored
from tidemark.session import rounds as until_done


# ---- rank -----------------------------------------------------------------------------------


def _weighted(graph: Graph) -> DataFrame:
    """Edges with 1 / out-degree of their source, computed once."""
    out = graph.edges.groupBy("src").agg((1.0 / F.count("*")).alias("w"))
    return stored(graph.edges.select("src", "dst").join(out, "src"))


def _rank_round(ranks: DataFrame, edges: DataFrame, reset: Column, damping: float) -> DataFrame:
    sent = edges.join(ranks.select(F.col("id").alias("src"), "rank"), "src")
    received = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("_in"))
    return ranks.select("id").join(received, "id", "left").select(
        "id", (reset + F.lit(damping) * F.coalesce("_in", F.lit(0.0))).alias("rank"))


def page_rank(graph: Graph, rounds: int, reset: float = 0.15, source: int | None = None) -> DataFrame:
    """Unnormalized rank: starts at 1, then reset + (1 - reset) * sum. ``source``: personalized."""
    edges = _weighted(graph)
    at_source = F.lit(1.0) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)
    ranks = stored(graph.vertices.select("id", at_source.alias("rank")))
    for _ in range(rounds):
        ranks = stored(_rank_round(ranks, edges, F.lit(reset) * at_source, 1 - reset))
    return ranks


def page_rank_until(graph: Graph, tolerance: float, reset: float = 0.15, max_rounds: int | None = None) -> DataFrame:
    """Rounds go on until no rank moves by more than ``tolerance``."""
    with shuffled_joins(graph.vertices.sparkSession):
        edges = _weighted(graph)
        ranks = stored(graph.vertices.select("id", F.lit(1.0).alias("rank")))
        for _ in until_done(max_rounds):
            new = stored(_rank_round(ranks, edges, F.lit(reset), 1 - reset))
            old = ranks.withColumnRenamed("rank", "_old")
            moved = new.join(old, "id").agg(F.max(F.abs(F.col("rank") - F.col("_old")))).first()[0]
            ranks = new
            if moved is None or moved <= tolerance:
                break
    return ranks


def contribution_rank(links: DataFrame, rounds: int) -> DataFrame:
    """The demo form: grouped distinct links, and only pages that receive something keep a rank."""
    edges = links.distinct()
    out = edges.groupBy("src").agg((1.0 / F.count("*")).alias("w"))
    weighted = stored(edges.join(out, "src"))
    ranks = stored(out.select(F.col("src").alias("id"), F.lit(1.0).alias("rank")))
    for _ in range(rounds):
        sent = weighted.join(ranks.withColumnRenamed("id", "src"), "src")
        ranks = stored(sent.groupBy(F.col("dst").alias("id")).agg(
            (0.15 + 0.85 * F.sum(F.col("rank") * F.col("w"))).alias("rank")))
    return ranks


# ---- components -----------------------------------------------------------------------------


def connected_components(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """(id, component): the smallest id that can be reached, directions ignored.

    Large-star and small-star steps by turns: each links neighbours to the smallest one near
    them, so long chains shrink by half a round instead of one step a round.
    """
    links = stored(_descending(graph.edges.where("src <> dst").select(
        F.col("src").alias("u"), F.col("dst").alias("v"))))
    mark = _fingerprint(links)
    for _ in until_done(max_rounds):
        links = stored(_small_star(_large_star(links)))
        now = _fingerprint(links)
        if now == mark:
            break
        mark = now
    labels = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return graph.vertices.select("id").join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def _descending(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's smallest neighbour."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _descending(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    """The vertex and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    sent = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _descending(sent.union(least))


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def strongly_connected_components(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """(id, component): smallest id of the strongly connected component.

    Vertices without in- or out-edges are components of their own and are taken away first. Then
    the smallest id is spread forward; what reaches a colour's root backward inside the colour is
    its component.
    """
    done: list[DataFrame] = []
    with shuffled_joins(graph.vertices.sparkSession):
        vertices = stored(graph.vertices.select("id"))
        edges = stored(graph.edges.where("src <> dst").select("src", "dst").distinct())
        for _ in until_done(max_rounds):
            inner = vertices.join(edges.select(F.col("src").alias("id")), "id", "left_semi").join(
                edges.select(F.col("dst").alias("id")), "id", "left_semi")
            trimmed = stored(vertices.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")))
            if not trimmed.isEmpty():
                done.append(trimmed)
                vertices, edges = _without(vertices, edges, trimmed)
                continue
            if vertices.isEmpty():
                break
            colours = pregel(Graph(vertices, edges), F.col("id"), F.least, lambda s, d: F.when(s < d, s), F.min).withColumnRenamed("state", "colour")
            same = edges.join(colours.withColumnsRenamed({"id": "src", "colour": "_a"}), "src").join(
                colours.withColumnsRenamed({"id": "dst", "colour": "_b"}), "dst").where("_a = _b").select(
                F.col("dst").alias("src"), F.col("src").alias("dst"))
            reached = pregel(
                Graph(colours, stored(same)), F.col("colour") == F.col("id"), lambda s, m: s | m,
                lambda s, d: F.when(s & ~d, F.lit(True)), F.bool_or)
            found = stored(reached.where("state").select("id").join(colours, "id").select("id", F.col("colour").alias("component")))
            done.append(found)
            vertices, edges = _without(vertices, edges, found)
    return reduce(DataFrame.union, done)


def _without(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("id")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return stored(vertices.join(ids, "id", "left_anti")), stored(left.select("src", "dst"))


# ---- structure ------------------------------------------------------------------------------


def triangle_count(graph: Graph) -> DataFrame:
    """(id, triangles). Edges point from the vertex of lower degree to that of higher degree, so
    no vertex has more than sqrt(2 * edges) out-neighbours to pair up, hubs included."""
    plain = graph.without_self_edges().canonical_edges(F.count("*").alias("_n")).edges.select("src", "dst")
    plain = stored(plain)
    degree = plain.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    ranked = plain.join(degree.withColumnsRenamed({"id": "src", "deg": "_a"}), "src").join(
        degree.withColumnsRenamed({"id": "dst", "deg": "_b"}), "dst")
    low = F.struct(F.col("_a").alias("deg"), F.col("src").alias("id"))
    high = F.struct(F.col("_b").alias("deg"), F.col("dst").alias("id"))
    ends = ranked.select(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))
    directed = stored(ends.select(F.col("low.id").alias("a"), F.col("high.id").alias("b"), F.col("high").alias("place")))
    # out-neighbours of one vertex paired in order of degree, then the closing edge is looked up
    left = directed.select("a", "b", "place")
    right = directed.select("a", F.col("b").alias("c"), F.col("place").alias("far"))
    closing = directed.select(F.col("a").alias("b"), F.col("b").alias("c"))
    wedges = left.join(right, "a").where(F.col("place") < F.col("far")).select("a", "b", "c")
    triangles = wedges.join(closing, ["b", "c"])
    counts = triangles.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return graph.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def label_propagation(graph: Graph, rounds: int) -> DataFrame:
    """(id, label): each round every vertex takes the most frequent label around it, the smallest
    on ties. Labels are counted per (vertex, label) first, so hubs are split by label."""
    edges = graph.edges.select("src", "dst")
    both = stored(edges.union(edges.select("dst", "src")))
    labels = stored(graph.vertices.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        sent = both.join(labels.withColumnRenamed("id", "src"), "src")
        counts = sent.groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
        best = counts.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("_new"))
        labels = stored(labels.join(best, "id", "left").select("id", F.coalesce("_new", "label").alias("label")))
    return labels


# ---- paths ----------------------------------------------------------------------------------


def shortest_hops(graph: Graph, landmarks: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, landmark, hops) along edge directions, breadth first from the landmarks backward."""
    edges = stored(graph.edges.select("src", F.col("dst").alias("id")).distinct())
    front = stored(landmarks.select("id", F.col("id").alias("landmark"), F.lit(0).alias("hops")))
    known = [front]
    for hops in (n + 1 for n in until_done(max_rounds)):
        seen = reduce(DataFrame.union, known).select("id", "landmark")
        step = edges.join(front.select("id", "landmark"), "id").select(F.col("src").alias("id"), "landmark").distinct()
        front = stored(step.join(seen, ["id", "landmark"], "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        known.append(front)
    return reduce(DataFrame.union, known)


def shortest_distance(graph: Graph, source: int, weight: str) -> DataFrame:
    """(id, state): least total weight from ``source``, infinity where there is no path."""
    start = F.when(F.col("id") == source, 0.0).otherwise(F.lit(float("inf")))
    return pregel(graph, start, F.least, lambda s, d: F.when(s + F.col(weight) < d, s + F.col(weight)), F.min)


def transitive_closure(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All (src, dst) with a path; only pairs found in the last round are extended."""
    with shuffled_joins(edges.sparkSession):
        step = stored(edges.select("src", "dst").distinct())
        new, known = step, [step]
        for _ in until_done(max_rounds):
            longer = new.withColumnRenamed("dst", "mid").join(step.withColumnsRenamed({"src": "mid"}), "mid").select("src", "dst").distinct()
            seen = reduce(DataFrame.union, known).toDF("_src", "_dst")
            new = stored(longer.join(seen, F.col("src").eqNullSafe(F.col("_src")) & F.col("dst").eqNullSafe(F.col("_dst")), "left_anti"))
            if new.isEmpty():
                break
            known.append(new)
    return reduce(DataFrame.union, known)


PIECE = 512  # ids of a piece, on average


def _classes(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(id, component) of all vertices, and the distinct (src, dst) of classes with an edge, loops included."""
    members = stored(strongly_connected_components(graph), "classes")
    one, two = members.toDF("src", "a"), members.toDF("dst", "b")
    linked = graph.edges.select("src", "dst").join(one, "src").join(two, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return members, stored(linked.distinct(), "class_links")


def _through_hubs(members: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths between different classes: (id, hub) of classes that reach a hub, (id, hub) of those that
    a hub reaches, hubs included in both, and the pairs (src, dst) without a path through a hub.

    The hub is the largest class of each part whose vertices are connected, so a class has one hub at
    most. All pairs of a class before and one behind the same hub have a path; they follow from the two
    lists and need no search. Every extension of such a pair is one too, so the search for the others drops them.
    """
    steps = stored(linked.where("src <> dst"), "class_steps")
    sizes = stored(members.groupBy(F.col("component").alias("id")).agg(F.count("*").alias("n")), "class_sizes")
    part = connected_components(Graph(sizes.select("id"), steps))
    biggest = sizes.join(part, "id").groupBy("component").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("hub"))
    marked = stored(sizes.select("id").join(biggest.select(F.col("hub").alias("id"), "hub"), "id", "left"), "hubs")

    def spread(edges: DataFrame) -> DataFrame:
        found = pregel(Graph(marked, edges), F.col("hub"), lambda s, m: F.coalesce(s, m), lambda s, d: F.when(s.isNotNull() & d.isNull(), s), F.max)
        return stored(found.where("state IS NOT NULL").select("id", F.col("state").alias("hub")), "spread")

    behind, before = spread(steps), spread(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    with shuffled_joins(linked.sparkSession):
        up = before.select(F.col("id").alias("src"), F.lit(True).alias("_up"))
        down = behind.select(F.col("id").alias("dst"), F.lit(True).alias("_down"))
        covered = F.coalesce("_up", F.lit(False)) & F.coalesce("_down", F.lit(False))
        known = steps.join(up, "src", "left").join(down, "dst", "left")
        step = stored(known.select("src", "dst", "_down"), "steps")
        new = stored(known.where(~covered).select("src", "dst", "_up"), "pairs")
        rest = [new.select("src", "dst")]
        for _ in until_done():
            longer = new.withColumnRenamed("dst", "mid").join(step.withColumnRenamed("src", "mid"), "mid").where(~covered).groupBy("src", "dst").agg(F.max("_up").alias("_up"))
            new = stored(longer.join(reduce(DataFrame.union, rest), ["src", "dst"], "left_anti"), "pairs")
            if new.isEmpty():
                break
            rest.append(new.select("src", "dst"))
    return before, behind, reduce(DataFrame.union, rest)


def _pieces(rows: DataFrame, group: str) -> DataFrame:
    """(group, ids): the ids of a group in lists of about PIECE, so a large group is many rows."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / PIECE).alias("_n"))
    cut = rows.join(sizes, group).withColumn("_piece", F.pmod(F.xxhash64("id"), F.col("_n")))
    return stored(cut.groupBy(group, "_piece").agg(F.collect_list("id").alias("ids")).select(group, "ids"), "pieces")


def _products(lists: DataFrame) -> DataFrame:
    """(src, dst): all pairs of the lists ``a`` and ``b`` of a row, written out where the rows are dealt to."""
    dealt = lists.select("a", "b").repartition(4 * shuffle_partitions(lists.sparkSession))
    return dealt.select(F.explode("a").alias("src"), "b").select("src", F.explode("b").alias("dst"))


def class_closure(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """The closure by classes: (id, component) of all vertices, and (src, dst) of classes with a path.

    Vertices that reach one another are one class, named by its smallest id, so a path from a to b is
    one from a's class to b's. A class reaches itself if it has several members or a loop. ``all_pairs``
    gives the pairs of vertices.
    """
    members, linked = _classes(graph)
    before, behind, rest = _through_hubs(members, linked)
    met = _pieces(before, "hub").toDF("hub", "a").join(_pieces(behind, "hub").toDF("hub", "b"), "hub")
    return members, _products(met).where("src <> dst").union(rest).union(linked.where("src = dst"))


def all_pairs(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path, as ``transitive_closure``, for graphs in which most vertices reach one another.

    Pairs are written out from the classes: those through a hub from the vertices before and behind it,
    the others from the members of two classes. None is found twice, so pairs are never shuffled. An edge
    from or to null has a vertex of its own, which only starts or only ends paths.
    """
    step = stored(edges.select("src", "dst").distinct(), "links")
    ends = step.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst")), F.count_if(F.col("src").isNull() | F.col("dst").isNull())).first()
    low, high = (ends[0] - 1, ends[1] + 1) if ends[0] is not None else (0, 1)
    whole = step if not ends[2] else step.select(F.coalesce("src", F.lit(low)).alias("src"), F.coalesce("dst", F.lit(high)).alias("dst"))
    members, linked = _classes(Graph.from_edges(whole))
    before, behind, rest = _through_hubs(members, linked)
    of_class = _pieces(members, "component")
    cyclic = stored(linked.where("src = dst"), "cyclic")

    def of_hub(side: DataFrame) -> DataFrame:
        inside = members.withColumnRenamed("component", "_class").join(side.toDF("_class", "hub"), "_class")
        return _pieces(inside.where("_class <> hub").select("id", "hub"), "hub")

    hubs = before.where("id = hub").select("hub")
    own = of_class.join(hubs.withColumnRenamed("hub", "component"), "component").toDF("hub", "ids")
    above, below = of_hub(before).toDF("hub", "a"), of_hub(behind).toDF("hub", "b")
    a, b = own.toDF("hub", "a"), own.toDF("hub", "b")
    through = above.join(below, "hub").union(above.join(b, "hub")).union(a.join(below, "hub")).select("a", "b")
    others = rest.union(cyclic.select("src", "dst"))
    between = others.join(of_class.toDF("src", "a"), "src").join(of_class.toDF("dst", "b"), "dst").select("a", "b")
    pairs = _products(through.union(between))
    return pairs if not ends[2] else pairs.select(F.nullif("src", F.lit(low)).alias("src"), F.nullif("dst", F.lit(high)).alias("dst"))


# ---- recommendation -------------------------------------------------------------------------


def svd_plus_plus(
    ratings: DataFrame, rank: int = 4, rounds: int = 3, gamma: float = 0.007, decay: float = 0.005, rate: float = 0.015, seed: int = 1
) -> tuple[DataFrame, DataFrame, float]:
    """Factors with biases and implicit feedback of (user, item, rating); returns users, items, mean.

    One factor is one column, so sums over a user's or item's ratings are partial aggregates and a
    popular item is never gathered in one task. A round is a full gradient step, averaged by the
    number of ratings; the ratings meet their factors once for the sums of both sides.
    """
    dims = range(rank)
    rows = stored(ratings.select("user", "item", "rating"))
    mean = rows.agg(F.avg("rating")).first()[0]

    def begin(side: str, prefix: str):
        sizes = rows.groupBy(side).agg(F.count("*").alias(f"{prefix}n"))
        return stored(sizes.withColumn(f"{prefix}b", F.lit(0.0)).withColumns(
            {f"{prefix}{j}": 0.1 * random.normal(seed + 10 * j, side) for j in dims}))

    users = begin("user", "p")
    items = stored(begin("item", "q").withColumns({f"y{j}": F.lit(0.0) for j in dims}))
    for _ in range(rounds):
        implicit = rows.join(items.select("item", *[f"y{j}" for j in dims]), "item").groupBy("user").agg(
            *[F.sum(f"y{j}").alias(f"z{j}") for j in dims])
        norm = 1 / F.sqrt("pn")
        tastes = users.join(implicit, "user").select(
            "user", "pb", norm.alias("norm"), *[(F.col(f"p{j}") + norm * F.col(f"z{j}")).alias(f"t{j}") for j in dims])
        full = rows.join(items.select("item", "qb", *[f"q{j}" for j in dims]), "item").join(stored(tastes, "tastes"), "user")
        guess = F.lit(mean) + F.col("pb") + F.col("qb") + reduce(lambda a, b: a + b, [F.col(f"q{j}") * F.col(f"t{j}") for j in dims])
        e = F.col("e")
        toward = F.explode(F.array(
            F.struct(F.lit(True).alias("of_user"), F.col("user").alias("id"), *[(e * F.col(f"q{j}")).alias(f"g{j}") for j in dims], F.lit(None).cast("double").alias("h")),
            F.struct(F.lit(False).alias("of_user"), F.col("item").alias("id"), *[(e * F.col(f"t{j}")).alias(f"g{j}") for j in dims], (e * F.col("norm")).alias("h"))))
        sums = full.withColumn("e", F.col("rating") - guess).select("e", toward.alias("to")).groupBy("to.of_user", "to.id").agg(
            F.count("e").alias("n"), *[F.sum(c).alias(name) for c, name in (("e", "e"), *[(f"to.g{j}", f"g{j}") for j in dims], ("to.h", "h"))])
        sums = stored(sums.select("of_user", "id", *[(F.col(c) / F.col("n")).alias(c) for c in ("e", *[f"g{j}" for j in dims], "h")]), "sums")
        users = stored(users.join(sums.where("of_user").withColumnRenamed("id", "user"), "user").select(
            "user", "pn", (F.col("pb") + gamma * (F.col("e") - decay * F.col("pb"))).alias("pb"),
            *[(F.col(f"p{j}") + gamma * (F.col(f"g{j}") - rate * F.col(f"p{j}"))).alias(f"p{j}") for j in dims]))
        items = stored(items.join(sums.where("NOT of_user").withColumnRenamed("id", "item"), "item").select(
            "item", "qn", (F.col("qb") + gamma * (F.col("e") - decay * F.col("qb"))).alias("qb"),
            *[(F.col(f"q{j}") + gamma * (F.col(f"g{j}") - rate * F.col(f"q{j}"))).alias(f"q{j}") for j in dims],
            # the mean over an item's ratings of error, norm and the item's own factor
            *[(F.col(f"y{j}") + gamma * (F.col("h") * F.col(f"q{j}") - rate * F.col(f"y{j}"))).alias(f"y{j}") for j in dims]))
    return users, items, mean


# ---- generators: the edges follow from the rows of a table ------------------------------------


def star(ids: DataFrame) -> DataFrame:
    """Every id but the first points to the first."""
    centre = ids.agg(F.min("id").alias("dst"))
    return ids.join(F.broadcast(centre), F.col("id") > F.col("dst")).select(F.col("id").alias("src"), "dst")  # one row


def grid(rows: int, columns: DataFrame) -> DataFrame:
    """``columns`` holds ids 0, 1, ..; vertex r * n + c points to its right and lower neighbour."""
    n = columns.agg(F.count("*").alias("n"))
    cells = columns.select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r")).crossJoin(F.broadcast(n))  # one row
    here = F.col("r") * F.col("n") + F.col("c")
    right = F.when(F.col("c") + 1 < F.col("n"), here + 1)
    below = F.when(F.col("r") + 1 < rows, here + F.col("n"))
    return cells.select(here.alias("src"), F.explode(F.array(right, below)).alias("dst")).where("dst IS NOT NULL")


def log_normal_edges(ids: DataFrame, mu: float, sigma: float, seed: int) -> DataFrame:
    """Out-degrees are log-normal; targets are uniform over the id range."""
    size = ids.agg((F.max("id") + 1).alias("_n"))
    degree = F.floor(random.log_normal(mu, sigma, seed, "id")).cast("int")
    spread = ids.withColumn("_d", degree).where("_d > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("_d"))).alias("k"))
    return spread.crossJoin(F.broadcast(size)).select(  # one row
        F.col("id").alias("src"), F.floor(random.uniform(seed + 7, "id", "k") * F.col("_n")).cast("bigint").alias("dst"))


def rmat_edges(keys: DataFrame, scale: int, seed: int, a: float = 0.45, b: float = 0.15, c: float = 0.15) -> DataFrame:
    """One edge per row: each of ``scale`` levels picks a quadrant of the adjacency matrix."""
    src, dst = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for level in range(scale):
        u = random.uniform(seed + level, "id")
        down = F.when(u >= a + b, 1).otherwise(0)
        right = F.when((u >= a) & (u < a + b) | (u >= a + b + c), 1).otherwise(0)
        src, dst = src * 2 + down, dst * 2 + right
    return keys.select(src.alias("src"), dst.alias("dst"))
