"""Running a stream over the table files until no input is left."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch, setting, shuffle_partitions
from tidemark.tables import Tables


ROWS_PER_FILE = 1_000_000
BYTES_PER_FILE = 64 << 20  # of text
ROWS_PER_STATE_PARTITION = 100_000

_input_rows: dict[str, int] = {}  # rows of the input made last, per application


@contextmanager
def sized(spark: SparkSession):
    """Start queries inside: their state gets no more partitions than the input needs.

    A stream keeps the number it starts with and adaptive execution does not merge state
    partitions, so hundreds of near-empty ones would be opened in every micro-batch. Large inputs
    keep the session's number.
    """
    rows = _input_rows.get(spark.sparkContext.applicationId)
    most = shuffle_partitions(spark)
    wanted = most if rows is None else min(most, max(8, rows // ROWS_PER_STATE_PARTITION))
    with setting(spark, "spark.sql.shuffle.partitions", str(wanted)):
        yield


def batch_files(df: DataFrame, batches: int = 4) -> tuple[str, int]:
    """Write ``df`` as files for ``batches`` micro-batches; returns the folder and files per batch.

    The number of files follows the number of rows and the length of their texts, so a micro-batch
    is written and read by many tasks, whether its rows are many or long.
    """
    path = scratch(df.sparkSession, "stream-input")
    texts = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = [F.sum(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)).cast("bigint") for x in texts]))] if texts else [F.lit(0)]
    rows, length = df.agg(F.count("*"), *size).first()
    _input_rows[df.sparkSession.sparkContext.applicationId] = rows
    width = max(rows // (batches * ROWS_PER_FILE), (length or 0) // (batches * BYTES_PER_FILE)) + 1
    df.repartition(batches * width).write.parquet(path)
    return path, width


def file_stream(t: Tables, name: str, batches: int = 4) -> DataFrame:
    """A table as a stream of about ``batches`` micro-batches. ``events.ts`` becomes an instant."""
    df = t.events_ts if name == "events" else getattr(t, name)
    path, width = batch_files(df, batches)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", width).parquet(path)


def time_steps(df: DataFrame, column: str, steps: int) -> list[DataFrame]:
    """``df`` cut into ``steps`` spans of equal time, earliest first, for ``run_steps``."""
    low, high = df.agg(F.min(F.unix_micros(column)), F.max(F.unix_micros(column))).first()
    micros = F.unix_micros(column)
    edges = [low + (high - low) * i // steps for i in range(1, steps)]
    parts = [df.where(micros < edges[0])]
    parts += [df.where((micros >= a) & (micros < b)) for a, b in zip(edges, edges[1:])]
    return [*parts, df.where(micros >= edges[-1])]


def run_append(stream: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run to the end into an exactly-once file sink and read the sink back."""
    spark = stream.sparkSession
    out = out or scratch(spark, "stream-output")
    with sized(spark):
        started = (
            stream.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint or scratch(spark, "stream-checkpoint"))
            .trigger(availableNow=True).start()
        )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Run an aggregate to the end and return the last complete result.

    Each micro-batch writes the whole result table to its own folder, so that a repeated batch
    overwrites itself; the last folder is read back.
    """
    spark = stream.sparkSession
    out = scratch(spark, "stream-output")
    last = {}

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        last["path"] = path

    with sized(spark):
        started = (
            stream.writeStream.foreachBatch(write).outputMode("complete")
            .option("checkpointLocation", checkpoint or scratch(spark, "stream-checkpoint"))
            .trigger(availableNow=True).start()
        )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last["path"])


def run_update(stream: DataFrame, keys: list[str], checkpoint: str | None = None) -> DataFrame:
    """Run in update mode; keep the newest row of each key."""
    spark = stream.sparkSession
    out = scratch(spark, "stream-output")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b{number}")

    with sized(spark):
        started = (
            stream.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint or scratch(spark, "stream-checkpoint"))
            .trigger(availableNow=True).start()
        )
    started.awaitTermination()
    versions = spark.read.parquet(f"{out}/*")
    rest = [c for c in stream.columns if c not in keys]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def run_batches(stream: DataFrame, each, schema: str) -> DataFrame:
    """Apply a batch function to every micro-batch and collect its rows in files."""
    spark = stream.sparkSession
    out = scratch(spark, "stream-output")

    def write(batch: DataFrame, number: int) -> None:
        each(batch, number).write.mode("overwrite").parquet(f"{out}/b{number}")

    with sized(spark):
        started = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", scratch(spark, "stream-checkpoint"))
            .trigger(availableNow=True).start()
        )
    started.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/*")




def run_steps(parts: list[DataFrame], start, label: str = "steps") -> str:
    """Feed ``parts`` one after the other; each becomes one micro-batch of the same query.

    ``start(stream, checkpoint)`` returns a started query. Every part runs in a new query object
    that recovers offsets and state from the checkpoint. Returns the checkpoint folder.
    """
    spark = parts[0].sparkSession
    source, checkpoint = scratch(spark, f"{label}-input"), scratch(spark, f"{label}-checkpoint")
    _input_rows[spark.sparkContext.applicationId] = sum(p.count() for p in parts)
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        start(stream, checkpoint).awaitTermination()
    return checkpoint


def to_files(stream: DataFrame, out: str, checkpoint: str):
    """Start an append query into an exactly-once file sink."""
    with sized(stream.sparkSession):
        return (
            stream.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def to_batches(stream: DataFrame, write, checkpoint: str, mode: str = "append"):
    """Start a query that gives every micro-batch to ``write(batch, number)``."""
    with sized(stream.sparkSession):
        return (
            stream.writeStream.foreachBatch(write).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
