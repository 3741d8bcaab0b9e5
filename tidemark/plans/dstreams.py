"""Discretized-stream operators, as Structured Streaming over micro-batches."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tidemark.plans.streams import WORD_COUNT, word_counts
from tidemark.registry import query
from tidemark.session import scratch
from tidemark.streaming.runner import (
    file_stream, run_append, run_batches, run_complete, run_steps, time_steps, to_batches, to_files,
)
from tidemark.streaming.state import running_totals, sessions


@query("st01_map_family", """
    SELECT event_id, upper(event_type) AS mapped, value * 2 AS doubled, part FROM events, LATERAL (SELECT unnest(['a', 'b']) AS part) WHERE value > 10""")
def _(t):
    """map, filter, mapPartitions, mapValues and flatMapValues in one pass."""
    def double(batches):
        for b in batches:
            i = b.schema.get_field_index("value")
            yield b.set_column(i, pa.field("doubled", pa.float64()), pc.multiply(b.column(i), 2.0))

    stream = file_stream(t, "events").where("value > 10").select("event_id", F.upper("event_type").alias("mapped"), "value")
    doubled = stream.mapInArrow(double, "event_id bigint, mapped string, doubled double")
    return run_append(doubled.withColumn("part", F.explode(F.array(F.lit("a"), F.lit("b")))))


@query("st01_glom", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def _(t):
    """Arrays of at most one Arrow batch, never a whole partition."""
    def glom(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], pa.list_(pa.int64()))], names=["ids"])

    gathered = run_append(file_stream(t, "events").select("event_id").mapInArrow(glom, "ids array<bigint>"))
    return gathered.select(F.explode("ids").alias("id")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("st02_filter", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value < 5")
def _(t):
    return run_append(file_stream(t, "events").where("event_type = 'click' AND value < 5").select("event_id", "value"))


@query("st03_flat_map", "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
def _(t):
    return run_append(file_stream(t, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word")))


@query("st04_union", "SELECT event_id AS id, 'event' AS kind FROM events UNION ALL SELECT o_orderkey, 'order' FROM orders")
def _(t):
    events = file_stream(t, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"))
    orders = file_stream(t, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    return run_append(events.union(orders))


@query("st05_transform", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0")
def _(t):
    """Any batch operation on each micro-batch, here a join and a sort."""
    buyers = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")

    def each(batch, number):
        return batch.join(buyers, "user_id").select("event_id", "c_mktsegment").sortWithinPartitions("event_id")

    return run_batches(file_stream(t, "events"), each, "event_id bigint, c_mktsegment string")


@query("st06_foreach_batch", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def _(t):
    out = scratch(t.spark, "outputs")

    def write(batch, number):
        kept = batch.select("event_id", "event_type").persist()
        for kind in ("error", "signup"):  # one read, several outputs
            kept.where(F.col("event_type") == kind).write.mode("overwrite").parquet(f"{out}/{kind}/b{number}")
        kept.unpersist()

    to_batches(file_stream(t, "events"), write, scratch(t.spark, "checkpoint")).awaitTermination()
    return t.spark.read.parquet(f"{out}/*/*")


def thirds(t):
    return [t.events_ts.where(F.col("event_id") % 3 == i) for i in range(3)]


@query("st07_reduce_by_key_per_batch", "SELECT event_id % 3 AS step, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    out = scratch(t.spark, "per-batch")

    def write(batch, number):
        batch.groupBy("event_type").agg(
            F.min(F.col("event_id") % 3).alias("step"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
        ).write.mode("overwrite").parquet(f"{out}/b{number}")

    run_steps(thirds(t), lambda s, c: to_batches(s, write, c))
    return t.spark.read.parquet(f"{out}/*")


@query("st08_window", """
    SELECT start, CAST(sum(event_id) AS BIGINT) AS ids, count(*) AS n FROM (SELECT event_id, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'),
        time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1""")
def _(t):
    windows = file_stream(t, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(
        F.sum("event_id").alias("ids"), F.count("*").alias("n"))
    done = run_complete(windows.select("w.start", "ids", "n"))
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st09_reduce_by_key_and_window", """
    SELECT start, user_id, round(sum(value), 4) AS total FROM (SELECT user_id, value, unnest([CAST(date_trunc('day', ts) AS TIMESTAMP),
        date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS start FROM events) GROUP BY 1, 2 HAVING sum(value) > 40""")
def _(t):
    """Rows enter each window's sum once, so nothing has to be taken out again; small sums are filtered."""
    windows = file_stream(t, "events").groupBy(F.window("ts", "3 days", "1 day").alias("w"), "user_id").agg(F.sum("value").alias("total"))
    done = run_complete(windows.select("w.start", "user_id", "total")).where("total > 40")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", F.round("total", 4).alias("total"))


@query("st10_update_state_by_key", """
    SELECT user_id, round(sum(v), 4) AS total, count(*) AS updates FROM (SELECT user_id, value AS v FROM events
        UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT user_id FROM events)) GROUP BY 1""")
def _(t):
    """Running state per user that starts from a table: the table is the first micro-batch."""
    users = t.events.select(F.col("user_id").alias("c_custkey"))
    initial = t.customer.join(users, "c_custkey", "left_semi").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    out = scratch(t.spark, "state")

    def start(stream, checkpoint):
        state = stream.groupBy("user_id").agg(F.sum("value").alias("total"), F.count("*").alias("updates"))
        return to_batches(state, lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b{n}"), checkpoint, "update")

    run_steps([initial, *[p.select("user_id", "value") for p in thirds(t)]], start)
    newest = t.spark.read.parquet(f"{out}/*").groupBy("user_id").agg(F.max_by(F.struct("total", "updates"), "batch").alias("v"))
    return newest.select("user_id", F.round("v.total", 4).alias("total"), "v.updates")


@query("st11_map_with_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t):
    """State per user and salt, so that one busy user's rows are shared by several tasks."""
    salt = F.pmod(F.xxhash64("event_id"), F.lit(8)).cast("int").alias("salt")
    salted = file_stream(t, "events").select("user_id", salt, "value")
    emitted = run_append(running_totals(salted, ["user_id", "salt"], "value"))
    latest = emitted.groupBy("user_id", "salt").agg(F.max_by(F.struct("n", "total"), "n").alias("v"))
    return latest.groupBy("user_id").agg(F.sum("v.n").alias("n"), F.round(F.sum("v.total"), 4).alias("total"))


@query("st11_state_timeout")
def _(t):
    out = scratch(t.spark, "sessions")

    def start(stream, checkpoint):
        return to_files(sessions(stream.withWatermark("ts", "1 hour"), "user_id", "ts", 12 * 60), out, checkpoint)

    run_steps(time_steps(t.events_ts.select("user_id", "ts"), "ts", 6), start)
    return t.spark.read.parquet(out)


@query("st12_state_snapshot", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """The state itself, read from the checkpoint after the run."""
    checkpoint = scratch(t.spark, "snapshot")
    counted = file_stream(t, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    run_complete(counted, checkpoint)
    return t.spark.read.format("statestore").load(checkpoint).select("key.event_type", F.col("value.count").alias("n"))


@query("st13_queue", "SELECT event_id, event_id % 3 AS step FROM events")
def _(t):
    out = scratch(t.spark, "queue")
    run_steps(thirds(t), lambda s, c: to_files(s.select("event_id", (F.col("event_id") % 3).alias("step")), out, c))
    return t.spark.read.schema("event_id bigint, step bigint").parquet(out)


@query("st15_text_files", "SELECT translate(text, chr(10) || chr(13), '  ') AS value FROM documents")
def _(t):
    path = scratch(t.spark, "lines")
    t.documents.select(F.translate("text", "\n\r", "  ").alias("value")).repartition(4).write.text(path)
    return run_append(t.spark.readStream.option("maxFilesPerTrigger", 1).text(path))


@query("st17_sql_per_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    def each(batch, number):
        batch.createOrReplaceTempView("tidemark_batch")
        return batch.sparkSession.sql("SELECT event_type, count(*) AS n FROM tidemark_batch GROUP BY event_type")

    per_batch = run_batches(file_stream(t, "events"), each, "event_type string, n bigint")
    return per_batch.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("st18_recoverable_word_count", WORD_COUNT)
def _(t):
    """The second half is counted by a new query that recovers counts from the checkpoint."""
    out, newest = scratch(t.spark, "recover"), {}

    def start(stream, checkpoint):
        def write(batch, number):
            newest["path"] = f"{out}/b{number}"
            batch.write.mode("overwrite").parquet(newest["path"])

        return to_batches(word_counts(stream), write, checkpoint, "complete")

    run_steps([t.documents.where("doc_id % 2 = 0"), t.documents.where("doc_id % 2 = 1")], start)
    return t.spark.read.parquet(newest["path"])


@query("st19_page_view_metrics", """
    SELECT 'views' AS metric, event_type AS key, count(*)::DOUBLE AS v FROM events GROUP BY 2
    UNION ALL SELECT 'zip views', CAST(user_id % 20 AS VARCHAR), count(*) FROM events GROUP BY 2
    UNION ALL SELECT 'error rate', CAST(user_id % 20 AS VARCHAR), round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) FROM events GROUP BY 2
    UNION ALL SELECT 'active', strftime(date_trunc('day', ts), '%Y-%m-%d'), count(DISTINCT user_id) FROM events GROUP BY 2""")
def _(t):
    """Views per page and zone, error rate per zone, and users per day (each user once a day)."""
    zone = (F.col("user_id") % 20).cast("string")

    def events():
        return file_stream(t, "events").withColumn("zone", zone)

    views = run_complete(events().groupBy("event_type").agg(F.count("*").alias("v")))
    zones = run_complete(events().groupBy("zone").agg(
        F.count("*").alias("v"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("rate")))
    days = run_complete(events().groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n")))
    active = days.groupBy(F.date_format("w.start", "yyyy-MM-dd").alias("key")).agg(F.count("*").alias("v"))

    def row(df, metric, key, v):
        return df.select(F.lit(metric).alias("metric"), F.col(key).alias("key"), v.cast("double").alias("v"))

    return reduce(lambda a, b: a.union(b), [
        row(views, "views", "event_type", F.col("v")), row(zones, "zip views", "zone", F.col("v")),
        row(zones, "error rate", "zone", F.round("rate", 6)), row(active, "active", "key", F.col("v"))])


@query("st20_grep", "SELECT doc_id, text FROM documents WHERE contains(text, 'license') OR contains(text, 'the')")
def _(t):
    stream = file_stream(t, "documents")
    return run_append(stream.where(F.col("text").contains("license") | F.col("text").contains("the")).select("doc_id", "text"))
