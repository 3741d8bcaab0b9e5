"""Property graphs as two DataFrames: vertices(id, ..) and edges(src, dst, ..).

Loops write their state to the shared folder each round: plans stay short, lost executors cost
one round at most, and the next round's joins see true sizes. Hub vertices: messages are
pre-aggregated before they are shuffled to their target; the join that reads a hub's state is an
equi-join that adaptive execution splits when one partition is oversized.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import rounds, shuffled_joins, stored


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame) -> Graph:
        return cls(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges)

    @classmethod
    def from_edge_list(cls, lines: DataFrame, canonical: bool = False) -> Graph:
        """Lines ``src dst`` separated by white space; lines that start with # are comments."""
        parts = F.split(F.trim("value"), r"\s+")
        kept = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
        edges = kept.select(parts[0].cast("bigint").alias("src"), parts[1].cast("bigint").alias("dst"))
        if canonical:
            edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return cls.from_edges(edges)

    def map_vertices(self, **columns: Column) -> Graph:
        return replace(self, vertices=self.vertices.withColumns(columns))

    def map_edges(self, **columns: Column) -> Graph:
        return replace(self, edges=self.edges.withColumns(columns))

    def reverse(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def subgraph(self, edge: Column | None = None, vertex: Column | None = None) -> Graph:
        """Vertices that pass, and edges that pass and whose two ends pass."""
        vertices = self.vertices if vertex is None else self.vertices.where(vertex)
        edges = self.edges if edge is None else self.edges.where(edge)
        if vertex is not None:
            ids = vertices.select("id")
            edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            edges = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(vertices, edges)

    def mask(self, other: Graph) -> Graph:
        """Only what also occurs in ``other``; attributes stay those of this graph."""
        return Graph(
            self.vertices.join(other.vertices.select("id"), "id", "left_semi"),
            self.edges.join(other.edges.select("src", "dst"), ["src", "dst"], "left_semi"),
        )

    def inner_join_edges(self, other: DataFrame) -> DataFrame:
        return self.edges.join(other, ["src", "dst"])

    def minus(self, other: DataFrame) -> DataFrame:
        return self.vertices.join(other.select("id"), "id", "left_anti")

    def diff(self, other: DataFrame, column: str) -> DataFrame:
        """Vertices of ``other`` whose value differs from this graph's."""
        mine = self.vertices.select("id", F.col(column).alias("_mine"))
        return other.join(mine, "id").where(~F.col(column).eqNullSafe(F.col("_mine"))).drop("_mine")

    def join_vertices(self, other: DataFrame, how: str = "left") -> Graph:
        return replace(self, vertices=self.vertices.join(other, "id", how))

    def triplets(self) -> DataFrame:
        """Edges with the attributes of both ends as structs ``s`` and ``d``."""
        s = self.vertices.select(F.col("id").alias("src"), F.struct("*").alias("s"))
        d = self.vertices.select(F.col("id").alias("dst"), F.struct("*").alias("d"))
        return self.edges.join(s, "src").join(d, "dst")

    def aggregate_messages(
        self, merge: Callable[[str], Column], to_dst: Column | None = None, to_src: Column | None = None
    ) -> DataFrame:
        """(id, message): messages written on triplets, merged at their target."""
        sent = self.triplets()
        if to_dst is not None and to_src is not None:
            # one pass over the triplets for both directions
            pairs = F.array(F.struct(F.col("dst").alias("id"), to_dst.alias("m")), F.struct(F.col("src").alias("id"), to_src.alias("m")))
            messages = sent.select(F.explode(pairs).alias("p")).select("p.*")
        elif to_dst is not None:
            messages = sent.select(F.col("dst").alias("id"), to_dst.alias("m"))
        else:
            messages = sent.select(F.col("src").alias("id"), to_src.alias("m"))
        return messages.where("m IS NOT NULL").groupBy("id").agg(merge("m").alias("message"))

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree) of vertices that have edges."""
        ends = self.edges.select(F.explode(F.array(
            F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        )).alias("e")).select("e.*")
        return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))

    def neighbours(self, direction: str = "either") -> DataFrame:
        """Distinct (id, neighbour) pairs, one row each: a hub's list is never held in one row."""
        out = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
        into = self.edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))
        pairs = {"out": out, "in": into, "either": out.union(into)}[direction]
        return pairs.distinct()

    def without_self_edges(self) -> Graph:
        return replace(self, edges=self.edges.where("src <> dst"))

    def canonical_edges(self, *merge: Column) -> Graph:
        """Parallel edges in either direction merged into one with src < dst."""
        ends = self.edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        return replace(self, edges=ends.groupBy("src", "dst").agg(*merge))

    def group_edges(self, *merge: Column) -> Graph:
        return replace(self, edges=self.edges.groupBy("src", "dst").agg(*merge))


def pregel(
    graph: Graph, initial: Column, program: Callable[[Column, Column], Column],
    send: Callable[[Column, Column], Column], merge: Callable[[str], Column], max_rounds: int | None = None,
) -> DataFrame:
    """(id, state) after rounds of messages along the edges, until none is sent.

    ``send(source state, target state)`` gives the message, NULL for none, and may use edge
    columns. Only vertices whose state changed in the last round send. Edges are written once, so
    a round reads them and doesn't make them again.
    """
    with shuffled_joins(graph.vertices.sparkSession):
        edges = stored(graph.edges, "edges")
        state = stored(graph.vertices.select("id", initial.alias("state"), F.lit(True).alias("active")))
        for _ in rounds(max_rounds):
            s = state.where("active").select(F.col("id").alias("src"), F.col("state").alias("_s"))
            d = state.select(F.col("id").alias("dst"), F.col("state").alias("_d"))
            triplets = edges.join(s, "src").join(d, "dst")
            messages = triplets.select(F.col("dst").alias("id"), send(F.col("_s"), F.col("_d")).alias("m")).where(
                "m IS NOT NULL").groupBy("id").agg(merge("m").alias("m"))
            joined = state.join(messages, "id", "left")
            new = F.when(F.col("m").isNull(), F.col("state")).otherwise(program(F.col("state"), F.col("m")))
            state = stored(joined.select("id", new.alias("state"), (~new.eqNullSafe(F.col("state"))).alias("active")))
            if state.where("active").isEmpty():
                break
    return state.drop("active")
