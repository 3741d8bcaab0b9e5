"""Task metrics, from Spark's event log or measured while a job runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import scratch

# Columns of the result and their place in a SparkListenerTaskEnd event: fixed names.
EVENT_METRICS = {
    "run_ms": "Executor Run Time",
    "cpu_ns": "Executor CPU Time",
    "deserialize_ms": "Executor Deserialize Time",
    "serialize_ms": "Result Serialization Time",
    "gc_ms": "JVM GC Time",
    "result_bytes": "Result Size",
    "memory_spilled": "Memory Bytes Spilled",
    "disk_spilled": "Disk Bytes Spilled",
    "input_bytes": "Input Metrics.Bytes Read",
    "input_records": "Input Metrics.Records Read",
    "output_bytes": "Output Metrics.Bytes Written",
    "output_records": "Output Metrics.Records Written",
    "shuffle_read_records": "Shuffle Read Metrics.Total Records Read",
    "shuffle_local_bytes": "Shuffle Read Metrics.Local Bytes Read",
    "shuffle_remote_bytes": "Shuffle Read Metrics.Remote Bytes Read",
    "fetch_wait_ms": "Shuffle Read Metrics.Fetch Wait Time",
    "shuffle_write_bytes": "Shuffle Write Metrics.Shuffle Bytes Written",
    "shuffle_write_records": "Shuffle Write Metrics.Shuffle Records Written",
    "shuffle_write_ns": "Shuffle Write Metrics.Shuffle Write Time",
}


def event_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an event log: one file, a folder of rolling files, or a folder of many applications' logs.

    Spark plans the scan by parts of files, cut between lines, on any file system; files that Spark
    writes compressed by zstd have to be unpacked first. Status files of rolling logs are empty.
    """
    return spark.read.option("recursiveFileLookup", "true").text(path)


def _at(json_path: str, kind: str) -> Column:
    return F.get_json_object("value", "$" + "".join(f"['{p}']" for p in json_path.split("/"))).cast(kind)


def event_log_metrics(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """One row per finished task attempt from an event log: stage, partition and its counters.

    Counters that an attempt doesn't have (failed ones have none) are 0. With ``group``, only
    stages of jobs of that job group.
    """
    lines = event_log_lines(spark, path)
    ends = lines.where(F.col("value").startswith('{"Event":"SparkListenerTaskEnd"'))
    tasks = ends.select(
        _at("Stage ID", "int").alias("stage"),
        _at("Task Info/Index", "int").alias("partition"),
        _at("Task Info/Attempt", "int").alias("attempt"),
        *[
            F.coalesce(_at("Task Metrics/" + p.replace("Metrics.", "Metrics/"), "bigint"), F.lit(0)).alias(c)
            for c, p in EVENT_METRICS.items()
        ],
    )
    if group is None:
        return tasks
    jobs = lines.where(F.col("value").startswith('{"Event":"SparkListenerJobStart"'))
    own = jobs.where(_at("Properties/spark.jobGroup.id", "string") == group).select(
        F.explode(F.from_json(_at("Stage IDs", "string"), "array<int>")).alias("stage")).distinct()
    return tasks.join(own, "stage", "left_semi")


@dataclass(frozen=True)
class Recording:
    """Where the events of a recorded block are, and the job group of its jobs."""

    spark: SparkSession
    path: str
    group: str

    def tasks(self) -> DataFrame:
        return event_log_metrics(self.spark, self.path, self.group)


@contextmanager
def recorded(spark: SparkSession, file_bytes: str = "32m") -> Iterator[Recording]:
    """Write the events of the jobs run inside as a rolling event log in the shared folder.

    For sessions that were started without one: a writer of Spark's event log is attached for the
    time of the block. Jobs of other threads are in the log too; ``Recording.tasks`` leaves them out.
    """
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    context = sc._jsc.sc()
    path, group = scratch(spark, "events"), f"recorded-{uuid.uuid4().hex}"
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(folder)
    conf = context.conf().clone()
    for key, value in {"enabled": "true", "compress": "false", "rolling.enabled": "true", "rolling.maxFileSize": file_bytes}.items():
        conf.set(f"spark.eventLog.{key}", value)
    writer = jvm.org.apache.spark.scheduler.EventLoggingListener(
        sc.applicationId, jvm.scala.Option.empty(), folder.toUri(), conf, sc._jsc.hadoopConfiguration())
    writer.start()
    context.addSparkListener(writer)
    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(group, group)
    try:
        yield Recording(spark, path, group)
    finally:
        for key, value in before.items():
            sc.setLocalProperty(key, value)
        context.listenerBus().waitUntilEmpty()
        context.removeSparkListener(writer)
        writer.stop()


_MEASURED = "stage int, partition int, attempt int, records bigint, bytes bigint, wall_us bigint, cpu_us bigint"


def measured_tasks(df: DataFrame) -> DataFrame:
    """Run ``df`` and return one row per task: records, bytes and time until its last batch."""

    def run(batches):
        context = TaskContext.get()
        wall, cpu = time.perf_counter(), time.process_time()
        records = size = 0
        for batch in batches:
            records += batch.num_rows
            size += batch.nbytes
        yield pa.RecordBatch.from_pylist([{
            "stage": context.stageId(), "partition": context.partitionId(),
            "attempt": context.attemptNumber(), "records": records, "bytes": size,
            "wall_us": int((time.perf_counter() - wall) * 1e6),
            "cpu_us": int((time.process_time() - cpu) * 1e6),
        }], schema=_arrow_schema())

    return df.mapInArrow(run, _MEASURED)


def _arrow_schema() -> pa.Schema:
    small, large = pa.int32(), pa.int64()
    return pa.schema([
        ("stage", small), ("partition", small), ("attempt", small), ("records", large),
        ("bytes", large), ("wall_us", large), ("cpu_us", large),
    ])


def stragglers(tasks: DataFrame, measures: list[str], factor: float = 2.0) -> DataFrame:
    """Tasks whose measure exceeds ``factor`` times the stage's median, by measure."""
    # a window, so that measured tasks run once; a stage has as many rows as it has tasks
    stage = Window.partitionBy("stage")
    joined = tasks.withColumns(
        {f"_median_{m}": F.percentile_approx(m, 0.5).over(stage) for m in measures}
    )
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"),
            F.col(f"_median_{m}").cast("double").alias("median"),
        )
        for m in measures
    ]))
    return (
        joined.select("stage", "partition", rows.alias("_m")).select("stage", "partition", "_m.*")
        .withColumn("ratio", F.try_divide("value", "median"))
        .withColumn("straggler", F.coalesce(F.col("ratio") > factor, F.lit(False)))
    )


def timed(function, result: T.DataType):
    """A pandas UDF that returns (value, elapsed_us) for each record of a user function.

    The time is that of the Python call alone; JVM expressions and Arrow transfer are outside it.
    """
    def one(value):
        began = time.perf_counter_ns()
        out = function(value)
        return out, (time.perf_counter_ns() - began) / 1000

    schema = T.StructType([T.StructField("value", result), T.StructField("elapsed_us", T.DoubleType())])

    @F.pandas_udf(schema)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["value", "elapsed_us"])

    return run
