"""Walking lineage backward and forward.

Only ids move through the joins of a trace; values are joined last, where they are shown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lineage.frame import COST, ID, TOTAL, LineageFrame


@dataclass(frozen=True, eq=False)
class Trace:
    """A set of record ids at one or several steps of a pipeline (``at``: step, ids).

    ``above`` tells of a step reached by ``go_next`` that its ids are those of all its records for which a
    part of the id, given as a function of it, is among some ids further up: (step, function, ids).
    """

    root: LineageFrame
    at: tuple[tuple[LineageFrame, DataFrame], ...]
    whole: bool = False  # all records of the step: nothing to restrict
    above: tuple[tuple[LineageFrame, Callable[[Column], Column], DataFrame], ...] = ()

    def ids(self, source: str | None = None) -> DataFrame:
        """Traced ids of a step, the first one if none is named; branches of one step are united."""
        return reduce(DataFrame.union, [ids for _, ids in self._step(source)]).distinct()

    def _step(self, name: str | None) -> list[tuple[LineageFrame, DataFrame]]:
        """All traced branches of one step: a step that feeds several branches was filtered for each."""
        found = [(f, ids) for f, ids in self.at if name is None or f.stage.name == name]
        if not found:
            raise LookupError(name)
        return [(f, ids) for f, ids in found if f.stage is found[0][0].stage]

    def filter(self, condition: Column | str) -> Trace:
        """Keep traced records by a condition on ``id`` or, joined in, on their values."""
        kept = []
        for frame, ids in self.at:
            text = condition if isinstance(condition, Column) else F.expr(condition)
            try:
                picked = ids.where(text)
                picked.schema  # resolves the condition
            except AnalysisException:
                rows = frame.df.withColumnRenamed(ID, "id")
                picked = rows.where(text).select("id")
                if not self.whole:
                    picked = picked.join(ids, "id", "left_semi")
            kept.append((frame, picked))
        return replace(self, at=tuple(kept), whole=False, above=())

    def go_back(self) -> Trace:
        """The distinct inputs of the traced records, one step up."""
        found: list[tuple[LineageFrame, DataFrame]] = []
        for frame, ids in self.at:
            stage = frame.stage
            if stage.kind == "source":
                found.append((frame, ids))
            for i, parent in enumerate(stage.parents):
                if stage.back:
                    inputs = ids.select(stage.back[i](F.col("id")).alias("id")).where("id is not null")
                else:
                    inputs = stage.edges[i].join(
                        ids.withColumnRenamed("id", "out_id"), "out_id", "left_semi"
                    ).select(F.col("in_id").alias("id"))
                found.append((parent, inputs.distinct()))
        return replace(self, at=_merged(found), whole=False, above=())

    def go_next(self) -> Trace:
        """All records, one step down, that any traced record contributed to."""
        children: dict[int, list[tuple[LineageFrame, int]]] = {}
        for frame in _frames(self.root):
            for i, parent in enumerate(frame.stage.parents):
                children.setdefault(id(parent), []).append((frame, i))
        found: list[tuple[LineageFrame, DataFrame]] = []
        known = {id(frame): (part, ids) for frame, part, ids in self.above}
        above = []
        for frame, ids in self.at:
            below = children.get(id(frame), [])
            if not below:
                found.append((frame, ids))
            # all inputs of a child are records of this step, so what tells its ids apart tells them apart too
            part, wanted = known.get(id(frame), (lambda c: c, ids))
            for child, i in below:
                if child.stage.back:  # an output's id holds its inputs'
                    holds = partial(lambda part, back, c: part(back(c)), part, child.stage.back[i])
                    edges = child.df.select(F.col(ID).alias("out_id"), holds(F.col(ID)).alias("id"))
                    above.append((child, holds, wanted))
                else:
                    edges = child.inputs()[i].select("out_id", part(F.col("in_id")).alias("id"))
                outputs = edges.where("id is not null").join(wanted, "id", "left_semi").select(F.col("out_id").alias("id"))
                found.append((child, outputs.distinct()))
        reached = [id(frame) for frame, _ in found]
        return replace(self, at=_merged(found), whole=False, above=tuple(a for a in above if reached.count(id(a[0])) == 1))

    def back_to_sources(self) -> Trace:
        """Repeat ``go_back`` over the fixed depth of the pipeline."""
        trace = self
        while any(f.stage.kind != "source" for f, _ in trace.at):
            trace = trace.go_back()
        return trace

    def show(self, step: str | None = None) -> DataFrame:
        """The distinct records behind the traced ids, ids included."""
        parts = [
            frame.df.withColumnRenamed(ID, "id").drop(COST, TOTAL).join(ids, "id", "left_semi") for frame, ids in self._step(step)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).distinct()

    def resume(self, shown: DataFrame) -> Trace:
        """Go on tracing from a subset of what ``show`` returned."""
        ids = shown.select("id").distinct()
        return replace(self, at=tuple((frame, ids) for frame, _ in self._step(None)), whole=False, above=())

    def replay(self) -> LineageFrame:
        """Run the pipeline again on the traced source records only."""
        behind = self.back_to_sources()
        stages = {f.stage.name: f.stage for f, _ in behind.at}
        return self.root.rerun({
            name: stage.origin.join(behind.ids(name).withColumnRenamed("id", ID), ID, "left_semi") for name, stage in stages.items()
        })

    def source_rows(self, source: str, table: DataFrame, key: list[str]) -> DataFrame:
        """Join traced source ids to the raw input table."""
        ids = self.back_to_sources().ids(source)
        return table.join(ids.select("id.*"), key, "left_semi")


def trace(frame: LineageFrame) -> Trace:
    """Start at the final records of a pipeline. Its sources are told apart by name."""
    named: dict[str, object] = {}
    for f in _frames(frame):
        if f.stage.kind == "source" and named.setdefault(f.stage.name, f.stage) is not f.stage:
            raise ValueError(f"two different sources are called {f.stage.name}")
    return Trace(frame, ((frame, frame.ids()),), whole=True)


def input_ids(frame: LineageFrame, side: int = 0) -> DataFrame:
    """Distinct input ids of the last stage."""
    return frame.inputs()[side].select("in_id").distinct()


def _frames(root: LineageFrame) -> list[LineageFrame]:
    seen: dict[int, LineageFrame] = {}

    def visit(f):
        if id(f) not in seen:
            seen[id(f)] = f
            for p in f.stage.parents:
                visit(p)

    visit(root)
    return list(seen.values())


def _merged(found):
    """Join ids that reached the same step by several ways."""
    by_step: dict[int, list] = {}
    for frame, ids in found:
        by_step.setdefault(id(frame), [frame, []])[1].append(ids)
    return tuple(
        (frame, many[0] if len(many) == 1 else reduce(DataFrame.union, many).distinct())
        for frame, many in by_step.values()
    )


def join_small(large: DataFrame, small: DataFrame, on: list[str], max_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``large`` whose key is in the traced set.

    The traced set is broadcast only if a bounded count shows that it is small; otherwise both
    sides are shuffled by the key.
    """
    keys = small.select(*on).distinct()
    if keys.limit(max_rows + 1).count() <= max_rows:
        keys = F.broadcast(keys)
    return large.join(keys, on, "left_semi")
