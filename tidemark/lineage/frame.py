"""DataFrames that carry record ids, so that each result row can name its inputs.

An id is a struct of key columns, never a partition position, so recomputing a lost task gives
the same ids. Ids are structural where possible: a join's id holds both input ids, a flat map's
id holds the input id and the position; such steps are traced back by a projection. Only
aggregates need an edge table, and that is a projection of their input: no ``collect_list``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_index

# the record's id, what it cost in its own stage, and the largest accumulated cost behind it
ID, COST, TOTAL = "_id", "_cost", "_total"
HIDDEN = (ID, COST, TOTAL)
EDGE = ("out_id", "in_id", "latency", "total")


class DuplicateIds(ValueError):
    """The key columns given for a source do not identify its rows."""


@dataclass(frozen=True, eq=False)
class Stage:
    """A step that makes new ids, with one edge table (out_id, in_id, latency, total) per parent.

    ``latency`` is what the input record cost inside its own stage, ``total`` the same with
    everything behind it. ``rows`` holds the links side by side (out_id, in_0, lat_0, in_1, ..)
    where an output has one input per parent, ``linked`` the records with the costs of their links
    (_lat_0, _total_0, ..). ``origin`` is the tagged table of a source.
    """

    name: str
    kind: str
    parents: tuple[LineageFrame, ...] = ()
    edges: tuple[DataFrame, ...] = ()
    rows: DataFrame | None = None
    linked: DataFrame | None = None
    back: tuple[Callable[[Column], Column], ...] = ()
    build: Callable[..., LineageFrame] | None = None
    origin: DataFrame | None = None


@dataclass(frozen=True, eq=False)
class LineageFrame:
    """A DataFrame with ids, the stage that made them, and the narrow steps applied since."""

    df: DataFrame
    stage: Stage | None
    capture: bool = True
    has_cost: bool = False
    filtered: bool = False
    narrow: tuple[Callable[[LineageFrame], LineageFrame], ...] = field(default=())

    # ---- sources -------------------------------------------------------------------------

    @classmethod
    def source(
        cls, df: DataFrame, name: str, key: Sequence[str], cost: Column | str | None = None,
        *, verify: bool = True, capture: bool = True,
    ) -> LineageFrame:
        """Tag the rows of ``df`` with an id made of its key columns.

        ``verify`` checks by one grouped count that the key is unique; leave it on unless the
        table guarantees it. Without a usable key see ``ordering.number_copies``.
        """
        if not capture:
            return cls(df, None, capture=False)
        if verify and not df.groupBy(*key).count().where("count > 1").isEmpty():
            raise DuplicateIds(f"{name}: {', '.join(key)} do not identify a row")
        costed = F.lit(0.0) if cost is None else (F.expr(cost) if isinstance(cost, str) else cost)
        tagged = df.withColumns({
            ID: F.struct(*key), COST: costed.cast("double"), TOTAL: costed.cast("double")
        })
        return cls(tagged, Stage(name, "source", origin=tagged), has_cost=cost is not None)

    @classmethod
    def collection(
        cls, spark: SparkSession, rows: Sequence[tuple], schema: str, name: str
    ) -> LineageFrame:
        """Tag an in-memory collection; the id is the position in the list."""
        numbered = [(i, *row) for i, row in enumerate(rows)]
        return cls.source(
            spark.createDataFrame(numbered, f"position bigint, {schema}"), name, ["position"],
            verify=False,
        )

    # ---- narrow steps: ids stay as they are ----------------------------------------------

    def _step(self, change, df: DataFrame, **flags) -> LineageFrame:
        return replace(self, df=df, narrow=(*self.narrow, change), **flags)

    def _kept(self) -> list[str]:
        return list(HIDDEN) if self.capture else []

    def map(self, *columns: Column | str, cost: Column | str | None = None) -> LineageFrame:
        """Project; ``cost`` adds what the user function spent on each record."""
        kept = self._kept()
        if cost is None or not self.capture:
            df = self.df.select(*kept, *columns)
        else:
            spent = F.expr(cost) if isinstance(cost, str) else cost
            df = self.df.withColumns(
                {COST: F.col(COST) + spent, TOTAL: F.col(TOTAL) + spent}
            ).select(*kept, *columns)
        return self._step(
            lambda f: f.map(*columns, cost=cost), df, has_cost=self.has_cost or cost is not None
        )

    def filter(self, condition: Column | str) -> LineageFrame:
        return self._step(
            lambda f: f.filter(condition), self.df.where(condition), filtered=True
        )

    def coalesce(self, n: int) -> LineageFrame:
        return self._step(lambda f: f.coalesce(n), self.df.coalesce(n))

    def sort(self, *order: Column | str) -> LineageFrame:
        return self._step(lambda f: f.sort(*order), self.df.orderBy(*order))

    def repartition_and_sort(self, n: int, *order: Column | str) -> LineageFrame:
        """Hash-partition by the first sort column and sort inside partitions."""
        df = self.df.repartition(n, order[0]).sortWithinPartitions(*order)
        return self._step(lambda f: f.repartition_and_sort(n, *order), df)

    # ---- steps that make new ids ---------------------------------------------------------

    def flat_map(
        self, array: Column, name: str, *columns: Column | str, split: str = "collection",
        stage: str = "flat_map",
    ) -> LineageFrame:
        """One row per element of ``array``.

        The time a record spent before is shared evenly by its elements (``split="collection"``,
        all elements made up front) or goes to the first one (``split="iterator"``).
        """
        if not self.capture:
            return replace(self, df=self.df.select(*columns, F.explode(array).alias(name)))
        made = self.df.withColumn("_array", array).select(
            *HIDDEN, *columns, F.size("_array").alias("_size"),
            F.posexplode("_array").alias("_pos", name),
        )
        share = {
            "collection": F.col(COST) / F.col("_size"),
            "iterator": F.when(F.col("_pos") == 0, F.col(COST)).otherwise(F.lit(0.0)),
        }[split]
        linked = made.withColumns(
            {"_in": F.col(ID), "_lat": share, TOTAL: F.col(TOTAL) - F.col(COST) + share,
             ID: F.struct(F.col(ID).alias("src"), F.col("_pos").alias("pos"))}
        )
        rows = linked.select(
            F.col(ID).alias("out_id"), F.col("_in").alias("in_0"), F.col("_lat").alias("lat_0"),
            F.col(TOTAL).alias("total_0"),
        )
        plain = [c for c in made.columns if c not in (*HIDDEN, "_size", "_pos")]
        out = [ID, F.lit(0.0).alias(COST), TOTAL, *plain]
        new = Stage(
            stage, "flat_map", (self,), (edge_of(rows, 0),), rows,
            linked.select(*out, F.col("_lat").alias("_lat_0"), F.col(TOTAL).alias("_total_0")), structural_back("flat_map", 1),
            lambda f: f.flat_map(array, name, *columns, split=split, stage=stage),
        )
        return LineageFrame(linked.select(*out), new)

    def aggregate(
        self, keys: Sequence[Column | str], *aggregates: Column, stage: str = "aggregate"
    ) -> LineageFrame:
        """Group and aggregate; the id is the group key itself, not its hash.

        The job keeps Spark's partial aggregation; edges are a projection of the input.
        """
        if not self.capture:
            return replace(self, df=self.df.groupBy(*keys).agg(*aggregates))
        columns = [F.col(k) if isinstance(k, str) else k for k in keys]
        named = self.df.select(*columns).columns
        carried = F.max(TOTAL) if self.costs_anything() else F.first(F.lit(0.0))
        grouped = self.df.groupBy(*columns).agg(*aggregates, carried.alias(TOTAL))
        plain = [c for c in grouped.columns if c != TOTAL]
        out = grouped.select(F.struct(*named).alias(ID), F.lit(0.0).alias(COST), TOTAL, *plain)
        edges = _edges_to(self.df, F.struct(*columns))
        new = Stage(
            stage, "aggregate", (self,), (edges,), None, None, (),
            lambda f: f.aggregate(keys, *aggregates, stage=stage),
        )
        return LineageFrame(out, new)

    def join(
        self, other: LineageFrame, on: Sequence[str], how: str = "inner", stage: str = "join"
    ) -> LineageFrame:
        """Join on common columns; the id holds the ids of both sides (null where absent)."""
        if not self.capture:
            return replace(self, df=self.df.join(other.df, list(on), how))
        left = self.df.withColumnsRenamed({ID: "_l", COST: "_lc", TOTAL: "_lt"})
        right = other.df.withColumnsRenamed({ID: "_r", COST: "_rc", TOTAL: "_rt"})
        joined = left.join(right, list(on), how).withColumn(
            ID, F.struct(F.col("_l").alias("left"), F.col("_r").alias("right"))
        )
        rows = joined.select(
            F.col(ID).alias("out_id"),
            F.col("_l").alias("in_0"), F.col("_lc").alias("lat_0"), F.col("_lt").alias("total_0"),
            F.col("_r").alias("in_1"), F.col("_rc").alias("lat_1"), F.col("_rt").alias("total_1"),
        )
        hidden = ("_l", "_lc", "_lt", "_r", "_rc", "_rt", ID)
        plain = [c for c in joined.columns if c not in hidden]
        out = [ID, F.lit(0.0).alias(COST), F.greatest("_lt", "_rt").alias(TOTAL), *plain]
        costs = {"_lc": "_lat_0", "_lt": "_total_0", "_rc": "_lat_1", "_rt": "_total_1"}
        new = Stage(
            stage, "join", (self, other), (edge_of(rows, 0), edge_of(rows, 1)), rows,
            joined.select(*out, *[F.col(c).alias(name) for c, name in costs.items()]), structural_back("join", 2),
            lambda a, b: a.join(b, on, how, stage),
        )
        return LineageFrame(joined.select(*out), new)

    def cogroup(
        self, other: LineageFrame, key: str, left_agg: Sequence[Column], right_agg: Sequence[Column],
        stage: str = "cogroup",
    ) -> LineageFrame:
        """Aggregate each side by key, then match the keys; one edge set per input."""
        if not self.capture:
            sides = [f.df.groupBy(key).agg(*a) for f, a in ((self, left_agg), (other, right_agg))]
            return replace(self, df=sides[0].join(sides[1], key, "full"))
        left = self.df.groupBy(key).agg(*left_agg, F.max(TOTAL).alias("_lt"))
        right = other.df.groupBy(key).agg(*right_agg, F.max(TOTAL).alias("_rt"))
        matched = left.join(right, key, "full")
        plain = [c for c in matched.columns if c not in ("_lt", "_rt")]
        out = matched.select(
            F.struct(key).alias(ID), F.lit(0.0).alias(COST), F.greatest("_lt", "_rt").alias(TOTAL), *plain
        )
        edges = tuple(_edges_to(f.df, F.struct(key)) for f in (self, other))
        new = Stage(
            stage, "cogroup", (self, other), edges, None, None, (),
            lambda a, b: a.cogroup(b, key, left_agg, right_agg, stage),
        )
        return LineageFrame(out, new)

    def union(self, *others: LineageFrame, stage: str = "union") -> LineageFrame:
        """Union by column name; the id says which input a row came from."""
        frames = (self, *others)
        if not self.capture:
            df = self.df
            for o in others:
                df = df.unionByName(o.df)
            return replace(self, df=df)
        types = [f.df.schema[ID].dataType for f in frames]
        out, links = None, []
        for i, f in enumerate(frames):
            ids = [
                (F.col(ID) if j == i else F.lit(None).cast(types[j])).alias(f"id_{j}")
                for j in range(len(frames))
            ]
            new_id = F.struct(F.lit(i).alias("src"), *ids)
            plain = [c for c in f.df.columns if c not in HIDDEN]
            part = f.df.select(new_id.alias(ID), F.lit(0.0).alias(COST), TOTAL, *plain)
            out = part if out is None else out.unionByName(part)
            links.append(_edges_to(f.df, new_id))
        new = Stage(
            stage, "union", frames, tuple(links), None, None, structural_back("union", len(frames)),
            lambda a, *b: a.union(*b, stage=stage),
        )
        return LineageFrame(out, new)

    def zip(self, order: Sequence[str], *others: tuple[LineageFrame, Sequence[str]]) -> LineageFrame:
        """Pair the n-th rows of several inputs, each put in its own order."""
        def placed(f, cols):
            return replace(f, df=with_index(f.df, cols, "position"))

        out = placed(self, order)
        for i, (other, cols) in enumerate(others):
            out = out.join(placed(other, cols), ["position"], stage=f"zip{i}")
        return out

    # ---- results -------------------------------------------------------------------------

    def values(self) -> DataFrame:
        """The result without ids."""
        return self.df.drop(*HIDDEN)

    def with_ids(self) -> DataFrame:
        """The result with its ids as ``_out_id``."""
        return self.df.withColumnRenamed(ID, "_out_id").drop(COST, TOTAL)

    def ids(self) -> DataFrame:
        return self.df.select(F.col(ID).alias("id"))

    def inputs(self) -> list[DataFrame]:
        """Edges per parent, without those whose output a later filter dropped."""
        if not self.filtered:
            return list(self.stage.edges)
        alive = self.df.select(F.col(ID).alias("out_id"))
        return [e.join(alive, "out_id", "left_semi") for e in self.stage.edges]

    def rerun(self, instead: dict[str, DataFrame]) -> LineageFrame:
        """Run the pipeline again with some sources' tagged rows replaced."""
        stage = self.stage
        if stage.kind == "source":
            tagged = instead.get(stage.name, stage.origin)
            if tagged is None:
                raise LookupError(f"source {stage.name} must be given to run the pipeline again")
            frame = LineageFrame(tagged, stage, has_cost=self.has_cost)
        else:
            frame = stage.build(*[p.rerun(instead) for p in stage.parents])
        for step in self.narrow:
            frame = step(frame)
        return frame

    def costs_anything(self) -> bool:
        """Does any record behind this frame carry a cost? If not, none is carried along."""
        return self.has_cost or any(p.costs_anything() for p in self.stage.parents)

    def sources(self) -> dict[str, LineageFrame]:
        if self.stage.kind == "source":
            return {self.stage.name: self}
        found: dict[str, LineageFrame] = {}
        for p in self.stage.parents:
            found.update(p.sources())
        return found


def structural_back(kind: str, parents: int) -> tuple[Callable[[Column], Column], ...]:
    """How to read each parent's id out of an output id; empty where only edges tell."""
    if kind == "flat_map":
        return (lambda c: c["src"],)
    if kind == "join":
        return (lambda c: c["left"], lambda c: c["right"])
    if kind == "union":
        return tuple((lambda c, j=j: c[f"id_{j}"]) for j in range(parents))
    return ()


def edge_of(rows: DataFrame, i: int) -> DataFrame:
    """One parent's edges from the side-by-side links."""
    return rows.where(F.col(f"in_{i}").isNotNull()).select(
        "out_id", F.col(f"in_{i}").alias("in_id"), F.col(f"lat_{i}").alias("latency"),
        F.col(f"total_{i}").alias("total"),
    )


def _edges_to(df: DataFrame, out_id: Column) -> DataFrame:
    """Edges from the records of ``df`` to the ids they go into."""
    return df.select(
        out_id.alias("out_id"), F.col(ID).alias("in_id"), F.col(COST).alias("latency"),
        F.col(TOTAL).alias("total"),
    )


def unpivoted_edges(frame: LineageFrame) -> list[DataFrame]:
    """All edges of the last stage with the side they came from."""
    return [
        e.select(F.lit(i).alias("side"), *EDGE) for i, e in enumerate(frame.inputs())
    ]
