"""Measured cost: what a user function spent on each record, and what its task spent besides.

A tap runs a function on every record of a frame and writes each record's time once, in the shared
folder, beside the record and its id; the last row of each task says how long the task took for
everything else: reading the shuffle, the aggregate before the tap, the way to Python. The table is
read again as the frame, so the same numbers are the edge costs of all steps behind it, however
often these run, and a lost executor loses none. A task that runs twice leaves the times of the
attempt that was committed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.lineage.frame import COST, ID, TOTAL, LineageFrame
from tidemark.session import stored

TASK, SPENT, REST, RECORDS, INPUTS, SHARE = "_task", "_spent_us", "_rest_us", "_records", "_inputs", "_share_us"


@dataclass(frozen=True, eq=False)
class Tap:
    """The frame behind a tap, and the times that were written there."""

    frame: LineageFrame
    records: DataFrame  # id, task, inputs, spent_us, share_us
    tasks: DataFrame  # task, records, inputs, spent_us, rest_us


def measure(df: DataFrame, function: Callable, argument: str, name: str, result: str) -> DataFrame:
    """``df`` with ``name``, the function of the column ``argument``, and the times of records and tasks.

    Microseconds. One row more per task: all its columns are null but the task's number, its
    records and the time that it spent outside the function.
    """
    added = T._parse_datatype_string(f"{name} {result}, {TASK} int, {SPENT} double, {REST} double, {RECORDS} bigint")
    fields = [*df.drop(name).schema.fields, *added.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    kept = [c for c in df.columns if c != name]

    def run(batches):
        arrow = to_arrow_schema(schema)
        task, began, spent, records = TaskContext.get().partitionId(), time.perf_counter_ns(), 0.0, 0
        for batch in batches:
            out, times = [], []
            for value in batch.column(batch.schema.get_field_index(argument)).to_pylist():
                start = time.perf_counter_ns()
                made = function(value)
                times.append((time.perf_counter_ns() - start) / 1000)
                out.append(made)
            n = batch.num_rows
            spent, records = spent + sum(times), records + n
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([
                *columns, pa.array(out, arrow.field(name).type), pa.array([task] * n, pa.int32()), pa.array(times, pa.float64()),
                pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())], names=arrow.names)
        rest = max(0.0, (time.perf_counter_ns() - began) / 1000 - spent)
        last = {TASK: pa.array([task], pa.int32()), REST: pa.array([rest], pa.float64()), RECORDS: pa.array([records], pa.int64())}
        yield pa.RecordBatch.from_arrays([last[f.name] if f.name in last else pa.nulls(1, f.type) for f in arrow], names=arrow.names)

    return df.mapInArrow(run, schema)


def tap(frame: LineageFrame, function: Callable, argument: str, name: str, result: str, *, stage_time: bool = True, label: str = "tap") -> Tap:
    """Run ``function`` on each record's ``argument`` and add its measured time to the record's cost.

    With ``stage_time`` the rest of each task's time is dealt out to the task's records by their
    shares of its inputs: an output of an aggregate counts the records it was made of, any other
    record counts one. Null arguments go to the function like others. A frame without rows gives
    one without rows. Without capture the function runs and nothing is written.
    """
    def again(f: LineageFrame) -> LineageFrame:
        return tap(f, function, argument, name, result, stage_time=stage_time, label=label).frame

    if not frame.capture:
        plain = measure(frame.df, function, argument, name, result).where(F.col(RECORDS).isNull())
        return Tap(replace(frame, df=plain.drop(TASK, SPENT, REST, RECORDS)), None, None)
    table = stored(measure(frame.df, function, argument, name, result), label)
    rows = table.where(F.col(RECORDS).isNull()).drop(REST, RECORDS)
    rows = _counted(rows, frame)
    ends = table.where(F.col(RECORDS).isNotNull()).select(TASK, RECORDS, REST)
    sums = rows.groupBy(TASK).agg(F.sum(INPUTS).alias(INPUTS), F.sum(SPENT).alias(SPENT))
    tasks = ends.join(sums, TASK, "left").select(
        F.col(TASK).alias("task"), F.col(RECORDS).alias("records"), F.coalesce(INPUTS, F.lit(0)).alias("inputs"),
        F.coalesce(SPENT, F.lit(0.0)).alias("spent_us"), F.col(REST).alias("rest_us"))
    share = F.lit(0.0)
    if stage_time:
        per_input = tasks.where("inputs > 0").select(F.col("task").alias(TASK), (F.col("rest_us") / F.col("inputs")).alias(REST))
        rows = rows.join(F.broadcast(per_input), TASK)  # one row per task
        share = F.col(REST) * F.col(INPUTS)
    costed = stored(rows.withColumn(SHARE, share).withColumns({
        COST: F.col(COST) + F.col(SPENT) + F.col(SHARE), TOTAL: F.col(TOTAL) + F.col(SPENT) + F.col(SHARE)}), label)
    records = costed.select(
        F.col(ID).alias("id"), F.col(TASK).alias("task"), F.col(INPUTS).alias("inputs"), F.col(SPENT).alias("spent_us"), F.col(SHARE).alias("share_us"))
    df = costed.drop(TASK, SPENT, INPUTS, SHARE, REST)
    return Tap(replace(frame, df=df, has_cost=True, narrow=(*frame.narrow, again)), records, tasks)


def _counted(rows: DataFrame, frame: LineageFrame) -> DataFrame:
    """Rows with the number of input records behind each: one, or the edges of an aggregate's output."""
    if frame.stage.kind not in ("aggregate", "cogroup"):
        return rows.withColumn(INPUTS, F.lit(1).cast("bigint"))
    edges = reduce(DataFrame.union, [e.select("out_id") for e in frame.inputs()])
    counts = edges.groupBy(F.col("out_id").alias(ID)).agg(F.count("*").alias(INPUTS))
    return rows.join(counts, ID)
