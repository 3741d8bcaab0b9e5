"""Structured Streaming over the event and document tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.registry import query
from tidemark.session import scratch
from tidemark.sources.rows import TextFileWriter
from tidemark.streaming.runner import (
    batch_files, file_stream, run_append, run_complete, run_steps, run_update, sized, time_steps, to_batches, to_files,
)

COUNTS = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"


def counts(stream):
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def rounded(df):
    return df.withColumn("total", F.round("total", 4))


@query("ss01_file_source", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    path, _ = batch_files(t.events_ts, 6)
    stream = t.spark.readStream.schema(t.events_ts.schema).options(
        maxFilesPerTrigger=2, latestFirst=True, maxFileAge="30d").parquet(path)
    return run_append(stream.select("event_id", "user_id", "event_type"))


@query("ss03_batches_by_hand", "SELECT event_id % 3 AS step, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """Batches given by hand: what arrived together is processed together."""
    out = scratch(t.spark, "by-hand")

    def write(batch, number):
        batch.groupBy((F.col("event_id") % 3).alias("step")).agg(F.count("*").alias("n")).withColumn(
            "batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b{number}")

    parts = [t.events_ts.where(F.col("event_id") % 3 == i) for i in range(3)]
    run_steps(parts, lambda s, c: to_batches(s, write, c))
    return t.spark.read.parquet(f"{out}/*").where("batch = step").select("step", "n")


@query("ss06_file_sink", "SELECT event_id, round(value * 2, 4) AS v FROM events WHERE event_type <> 'error'")
def _(t):
    stream = file_stream(t, "events").where("event_type <> 'error'")
    return run_append(stream.select("event_id", F.round(F.col("value") * 2, 4).alias("v")))


@query("ss07_memory_sink", COUNTS)
def _(t):
    name = f"tidemark_{uuid.uuid4().hex}"
    counted = counts(file_stream(t, "events"))
    with sized(t.spark):
        started = counted.writeStream.format("memory").queryName(name).outputMode("complete").option(
            "checkpointLocation", scratch(t.spark, "memory")).trigger(availableNow=True).start()
    started.awaitTermination()
    return rounded(t.spark.table(name))


@query("ss09_foreach_sink", "SELECT count(*) AS lines FROM events WHERE event_type = 'purchase'")
def _(t):
    path = scratch(t.spark, "foreach")
    uri = path if "://" in path else f"file://{path}"

    class Sink:
        def open(self, partition, epoch):
            self.writer = TextFileWriter(f"{uri}/epoch={epoch}")
            return self.writer.open(partition, 0)

        def process(self, row):
            self.writer.process(row.asDict())

        def close(self, error):
            self.writer.close(error)

    stream = file_stream(t, "events").where("event_type = 'purchase'").select("event_id", "user_id")
    stream.writeStream.foreach(Sink()).option("checkpointLocation", scratch(t.spark, "checkpoint")).trigger(
        availableNow=True).start().awaitTermination()
    return t.spark.read.text(path).agg(F.count("value").alias("lines"))


@query("ss10_output_modes", f"""
    SELECT 'append' AS mode, event_type, count(*) AS n FROM events GROUP BY 2 UNION ALL
    SELECT 'update', event_type, n FROM ({COUNTS}) UNION ALL SELECT 'complete', event_type, n FROM ({COUNTS})""")
def _(t):
    appended = run_append(file_stream(t, "events").select("event_type"))
    updated = run_update(counts(file_stream(t, "events")), ["event_type"])
    complete = run_complete(counts(file_stream(t, "events")))
    n = F.count("*").alias("n")
    return appended.groupBy("event_type").agg(n).select(F.lit("append").alias("mode"), "event_type", "n").union(
        updated.select(F.lit("update"), "event_type", "n")).union(complete.select(F.lit("complete"), "event_type", "n"))


HOURLY = "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("ss11_watermark_append", f"""
    SELECT start, event_type, n FROM ({HOURLY}) WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def _(t):
    """Append mode gives a window once, when the watermark has passed its end."""
    out = scratch(t.spark, "windows")

    def start(stream, checkpoint):
        windows = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
        return to_files(windows.select("w.start", "event_type", "n"), out, checkpoint)

    run_steps(time_steps(t.events_ts.select("ts", "event_type"), "ts", 4), start)
    done = t.spark.read.schema("start timestamp, event_type string, n bigint").parquet(out)
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ss11_late_rows_dropped", """
    WITH on_time AS (SELECT * FROM events WHERE event_id % 10 <> 0), mark AS (SELECT max(ts) - INTERVAL 5 DAY AS m FROM on_time),
    kept AS (SELECT * FROM on_time UNION ALL SELECT e.* FROM events AS e, mark
             WHERE event_id % 10 = 0 AND date_trunc('day', ts) + INTERVAL 1 DAY > date_trunc('milliseconds', m))
    SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM kept GROUP BY 1""")
def _(t):
    """A tenth of the rows comes after the others; those behind the watermark are dropped."""
    out = scratch(t.spark, "late")

    def start(stream, checkpoint):
        days = stream.withWatermark("ts", "5 days").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))

        def write(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b{number}")

        return to_batches(days.select(F.col("w.start").alias("day"), "n"), write, checkpoint, "update")

    rows = t.events_ts.select("event_id", "ts")
    run_steps([rows.where("event_id % 10 <> 0"), rows.where("event_id % 10 = 0")], start)
    newest = t.spark.read.parquet(f"{out}/*").groupBy("day").agg(F.max_by("n", "batch").alias("n"))
    return newest.select(F.col("day").cast("timestamp_ntz").alias("day"), "n")


@query("ss12_stateful_aggregate", COUNTS)
def _(t):
    return rounded(run_complete(counts(file_stream(t, "events"))))


@query("ss13_tumbling_window", HOURLY)
def _(t):
    windows = file_stream(t, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    done = run_complete(windows.select("w.start", "event_type", "n"))
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ss14_sliding_window", """
    SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'),
        time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2""")
def _(t):
    windows = file_stream(t, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    done = run_complete(windows.select("w.start", "event_type", "n"))
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


WORD_COUNT = "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1"


def word_counts(stream):
    return stream.select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("ss15_running_word_count", WORD_COUNT)
def _(t):
    return run_complete(word_counts(file_stream(t, "documents", 3)))


@query("ss16_stateless", "SELECT event_id, upper(event_type) AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE value > 20")
def _(t):
    stream = file_stream(t, "events").where("value > 20")
    return run_append(stream.select("event_id", F.upper("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k")))


@query("ss17_processing_time")
def _(t):
    out = scratch(t.spark, "timed")
    started = file_stream(t, "events").select("event_id").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch(t.spark, "checkpoint")).trigger(processingTime="1 second").start()
    try:
        started.processAllAvailable()
    finally:
        started.stop()
    return t.spark.read.schema("event_id bigint").parquet(out)


@query("ss18_restart", "SELECT event_id, event_type FROM events")
def _(t):
    """Two runs with one checkpoint: the second reads only what the first did not."""
    out = scratch(t.spark, "restart")
    rows = t.events_ts.select("event_id", "event_type")
    run_steps([rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")], lambda s, c: to_files(s, out, c))
    return t.spark.read.schema(rows.schema).parquet(out)


@query("ss20_progress")
def _(t):
    counted = counts(file_stream(t, "events"))
    with sized(t.spark):
        started = counted.writeStream.format("noop").outputMode("complete").option(
            "checkpointLocation", scratch(t.spark, "progress")).trigger(availableNow=True).start()
    started.awaitTermination()
    rows = [
        (p.batchId, p.numInputRows, float(p.processedRowsPerSecond), sum(s.numRowsTotal for s in p.stateOperators))
        for p in started.recentProgress
    ]
    return t.spark.createDataFrame(rows, "batch bigint, input_rows bigint, rows_per_second double, state_rows bigint")


@query("ss21_listener")
def _(t):
    seen: list[tuple[str, str]] = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            seen.append(("started", str(event.runId)))

        def onQueryProgress(self, event):
            seen.append(("progress", str(event.progress.runId)))

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            seen.append(("terminated", str(event.runId)))

    listener = Listener()
    t.spark.streams.addListener(listener)
    try:
        started = file_stream(t, "events").writeStream.format("noop").option(
            "checkpointLocation", scratch(t.spark, "listen")).trigger(availableNow=True).start()
        started.awaitTermination()
        run, deadline = str(started.runId), time.monotonic() + 20
        while ("terminated", run) not in seen and time.monotonic() < deadline:
            time.sleep(0.1)  # events come on another thread
    finally:
        t.spark.streams.removeListener(listener)
    kinds = [(kind, sum(k == kind and r == run for k, r in seen)) for kind in ("started", "progress", "terminated")]
    return t.spark.createDataFrame(kinds, "event string, n int")
