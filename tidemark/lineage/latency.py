"""Cost of records along the lineage, and the saving if a record were removed.

For one output, let each input j carry (lat_j, rm_j, slow_j) and let w be the slowest input
(smallest id on ties). Then latency = lat_w, slowest = slow_w and
rm = max over j of (slow_j = slow_w ? rm_j : lat_j). Grouped by (output, slow) first, this is
max(rm of w's group, latency of the second group), so two top rows per output are enough and a
hot output never sits in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.lineage.frame import COST, ID, TOTAL, LineageFrame
from tidemark.operators.ordering import with_index


def own_costs(frame: LineageFrame) -> DataFrame:
    return frame.df.select(F.col(ID).alias("id"), F.col(COST).alias("latency"))


def carried_latency(frame: LineageFrame) -> DataFrame:
    """(id, latency) with the slowest input counting, as carried along by the job itself.

    Costs one more ``max`` in each aggregate of the job, and no join.
    """
    return frame.df.select(F.col(ID).alias("id"), F.col(TOTAL).alias("latency"))


def trace_latency(frame: LineageFrame, combine=F.max) -> DataFrame:
    """(id, latency) of each final record, computed from edge tables after the job.

    Combined input latency plus the stage's own cost; ``combine`` is an aggregate function, the
    slowest input by default. Works on stored lineage too.
    """
    stage = frame.stage
    if stage.kind == "source":
        return own_costs(frame)
    if stage.rows is not None:
        total = _by_row(frame, combine)
    else:
        total = reduce(DataFrame.union, [
            _known(frame, i, combine).select("out_id", "latency") for i in range(len(stage.parents))
        ]).groupBy("out_id").agg(combine("latency").alias("latency"))
    total = total.withColumnRenamed("out_id", "id")
    if frame.has_cost:
        spent = own_costs(frame).withColumnRenamed("latency", "_own")
        total = total.join(spent, "id").select("id", (F.col("latency") + F.col("_own")).alias("latency"))
    return total


def _known(frame: LineageFrame, i: int, combine) -> DataFrame:
    """Edges of parent i with accumulated latency; a source's edges have it already."""
    edges, parent = frame.inputs()[i], frame.stage.parents[i]
    if parent.stage.kind == "source" and not parent.stage.parents:
        return edges
    before = trace_latency(parent, combine).withColumnsRenamed({"id": "in_id", "latency": "_before"})
    return edges.join(before, "in_id").select("out_id", "in_id", F.col("_before").alias("latency"))


def _by_row(frame: LineageFrame, combine) -> DataFrame:
    """One input per parent: no grouping, the inputs stand side by side."""
    stage = frame.stage
    rows = stage.rows
    if frame.filtered:
        rows = rows.join(frame.df.select(F.col(ID).alias("out_id")), "out_id", "left_semi")
    for i, parent in enumerate(stage.parents):
        if parent.stage.kind != "source":
            before = trace_latency(parent, combine).withColumnsRenamed({"id": f"in_{i}", "latency": "_before"})
            share = F.col("_before")
            if stage.kind == "flat_map":  # the part of the record's time that this element got
                share = F.col("_before") - F.col(f"_own_{i}") + F.col(f"lat_{i}")
                before = before.join(
                    own_costs(parent).withColumnsRenamed({"id": f"in_{i}", "latency": f"_own_{i}"}), f"in_{i}"
                )
            rows = rows.join(before, f"in_{i}", "left").withColumn(f"lat_{i}", share).drop("_before", f"_own_{i}")
    lats = [F.col(f"lat_{i}") for i in range(len(stage.parents))]
    joined = lats[0] if len(lats) == 1 else F.greatest(*lats)
    if combine is F.sum and len(lats) > 1:
        joined = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in lats])
    return rows.select("out_id", joined.alias("latency"))


# ---- removal of the slowest input ---------------------------------------------------------


def removal(frame: LineageFrame, blame: str) -> DataFrame:
    """(id, latency, rm_latency, slowest, destructive) of each final record.

    ``slowest`` is the id of the record of source ``blame`` behind the largest latency, and
    ``rm_latency`` the latency without it. Steps that the blamed source does not reach add nothing.
    """
    stage = frame.stage
    if stage.kind == "source":
        return leaf_state(own_costs(frame))
    path = _id_path(frame, blame)
    if path is not None:
        ids = carried_latency(frame).withColumn("slowest", path(F.col("id")))
        return ids.select(
            "id", "latency", F.lit(0.0).alias("rm_latency"), "slowest", F.lit(True).alias("destructive")
        )
    sides = [i for i, p in enumerate(stage.parents) if blame in p.sources()]
    inputs = [_state_edges(frame, i, blame) for i in sides]
    if stage.kind in ("flat_map", "union") or (stage.kind == "join" and len(sides) == 1):
        state = reduce(DataFrame.union, inputs)  # one input each: nothing is merged
    else:
        state = merge_states(reduce(DataFrame.union, inputs), "out_id")
    state = state.withColumnRenamed("out_id", "id")
    if frame.has_cost:
        spent = own_costs(frame).withColumnRenamed("latency", "_own")
        state = add_stage(state.join(spent, "id"), F.col("_own")).drop("_own")
    return state


def _id_path(frame: LineageFrame, blame: str):
    """How to read the blamed record's id out of a structural id, if it is there alone.

    Then each record has exactly one blamed input, nothing was merged, and its carried latency
    is that input's: the state is a projection.
    """
    stage = frame.stage
    if stage.kind == "source":
        return (lambda c: c) if stage.name == blame else None
    if stage.kind not in ("flat_map", "join") or stage.rows is None:
        return None
    sides = [i for i, p in enumerate(stage.parents) if blame in p.sources()]
    others = [p for i, p in enumerate(stage.parents) if i not in sides]
    if len(sides) != 1 or any(p.costs_anything() for p in others):
        return None
    above = _id_path(stage.parents[sides[0]], blame)
    step = stage.back[sides[0]]
    return None if above is None else (lambda c: above(step(c)))


def _state_edges(frame: LineageFrame, i: int, blame: str) -> DataFrame:
    edges, parent = frame.inputs()[i], frame.stage.parents[i]
    path = _id_path(parent, blame)
    if path is not None and frame.stage.kind != "flat_map":
        return edges.select(
            "out_id", F.col("total").alias("latency"), F.lit(0.0).alias("rm_latency"),
            path(F.col("in_id")).alias("slowest"), F.lit(True).alias("destructive"),
        )
    before = removal(parent, blame).withColumnRenamed("id", "in_id")
    joined = edges.withColumnRenamed("latency", "_share").join(before, "in_id")
    if frame.stage.kind == "flat_map":
        own = own_costs(parent).withColumnsRenamed({"id": "in_id", "latency": "_own"})
        joined = add_stage(joined.join(own, "in_id"), F.col("_share") - F.col("_own"))
    return joined.select("out_id", "latency", "rm_latency", "slowest", "destructive")


def leaf_state(costs: DataFrame) -> DataFrame:
    """A source record is its own slowest input; removing it destroys its output."""
    return costs.select(
        *[c for c in costs.columns if c != "latency"], "latency", F.lit(0.0).alias("rm_latency"),
        F.col("id").alias("slowest"), F.lit(True).alias("destructive"),
    )


def add_stage(state: DataFrame, spent: Column) -> DataFrame:
    """Pass a stage: its cost also remains after the removal, unless the output is gone then."""
    return state.withColumns({
        "latency": F.col("latency") + spent,
        "rm_latency": F.col("rm_latency") + F.when(F.col("destructive"), F.lit(0.0)).otherwise(spent),
    })


def merge_states(inputs: DataFrame, by: str) -> DataFrame:
    """Merge the states of all inputs of an output (``by``)."""
    per_record = inputs.groupBy(by, "slowest").agg(
        F.max("latency").alias("latency"), F.max("rm_latency").alias("rm_latency"),
        F.count("*").alias("_n"), F.min("destructive").alias("destructive"),
    )
    slow_first = Window.partitionBy(by).orderBy(F.desc("latency"), "slowest")
    top = per_record.withColumn("_rank", F.row_number().over(slow_first)).where("_rank <= 2")
    first = F.col("_rank") == 1
    return top.groupBy(by).agg(
        F.max(F.when(first, F.col("latency"))).alias("latency"),
        F.max(F.when(first, F.col("rm_latency")).otherwise(F.col("latency"))).alias("rm_latency"),
        F.max(F.when(first, F.col("slowest"))).alias("slowest"),
        ((F.max("_rank") == 1) & (F.max("_n") == 1) & F.min("destructive")).alias("destructive"),
    )


def slowest_inputs(state: DataFrame) -> DataFrame:
    """Impact of each input over the outputs it is the slowest of."""
    return state.groupBy(F.col("slowest").alias("id")).agg(
        F.max("latency").alias("latency"), F.max("rm_latency").alias("rm_latency"),
        (F.max("latency") - F.max("rm_latency")).alias("impact"),
    )


def impact_by_output(state: DataFrame) -> DataFrame:
    """Each output's state with the impact of its slowest input over all outputs it is slowest of."""
    same = Window.partitionBy("slowest")
    return state.withColumn("impact", F.max("latency").over(same) - F.max("rm_latency").over(same))


def take_slowest(state: DataFrame, n: int) -> DataFrame:
    return slowest_inputs(state).orderBy(F.desc("impact"), "id").limit(n)


def single_slowest(state: DataFrame) -> DataFrame:
    """The slowest input with the saving for the whole job: best - max(best.rm, second)."""
    ranked = state.orderBy(F.desc("latency"), "id").limit(2)
    place = Window.orderBy(F.desc("latency"), "id")  # two rows
    pair = ranked.withColumn("_rank", F.row_number().over(place)).withColumn(
        "_second", F.lead("latency").over(place)
    )
    return pair.where("_rank = 1").select(
        F.col("slowest").alias("id"), "latency",
        (F.col("latency") - F.greatest("rm_latency", "_second")).alias("saving"),
    )


def top_inputs(edges: DataFrame, n: int) -> DataFrame:
    """The n slowest distinct inputs of each output, one row each with its place."""
    distinct = edges.groupBy("out_id", "in_id").agg(F.max("latency").alias("latency"))
    place = Window.partitionBy("out_id").orderBy(F.desc("latency"), "in_id")
    return distinct.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def bounded(edges: DataFrame, k: int | None) -> DataFrame:
    """Keep the k slowest inputs per output (``None``: all, the default everywhere)."""
    return edges if k is None else top_inputs(edges, k).drop("place")


# ---- reading latencies --------------------------------------------------------------------


def take(latencies: DataFrame, n: int, ascending: bool = False) -> DataFrame:
    order = F.asc("latency") if ascending else F.desc("latency")
    return latencies.orderBy(order, "id").limit(n)


def percentile(latencies: DataFrame, share: float, ascending: bool = False) -> DataFrame:
    """The slowest (or fastest) floor(share * count) records."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    order = F.asc("latency") if ascending else F.desc("latency")
    total = latencies.agg(F.floor(F.count("*") * F.lit(share)).alias("_keep"))
    placed = with_index(latencies, [order, F.asc("id")], "_place")
    return placed.join(F.broadcast(total), F.col("_place") < F.col("_keep")).drop("_place", "_keep")


def partition_stats(edges: DataFrame, partition: Column | None = None) -> DataFrame:
    """Inputs, outputs and summed latency per shuffle partition."""
    where = F.spark_partition_id() if partition is None else partition
    per_key = edges.groupBy(where.alias("partition"), "out_id").agg(
        F.count("*").alias("inputs"), F.sum("latency").alias("latency")
    )
    return per_key.groupBy("partition").agg(
        F.sum("inputs").alias("num_inputs"), F.count("*").alias("num_outputs"),
        F.sum("latency").alias("latency"),
    )


def spread_stage_latency(edges: DataFrame, partition: Column, stage_latency: Column) -> DataFrame:
    """Give each output its share of a partition's stage latency by its share of inputs."""
    per_out = edges.groupBy(partition.alias("partition"), "out_id").agg(F.count("*").alias("inputs"))
    totals = per_out.groupBy("partition").agg(F.sum("inputs").alias("total"))
    return per_out.join(totals, "partition").withColumn(
        "share", stage_latency * F.col("inputs") / F.col("total")
    )
