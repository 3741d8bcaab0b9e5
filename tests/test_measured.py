"""Measured times through shuffles, the event log as a source, and sequential patterns against brute force."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import functions as F

from tidemark.lineage import latency, metrics, taps
from tidemark.lineage.frame import ID, LineageFrame
from tidemark.lineage.trace import trace
from tidemark.ml.patterns import sequential_patterns
from tidemark.plans.models import user_steps
from tidemark.session import local_session


def slow_function():
    def slow(n):  # made here, so that it goes to the workers by value
        time.sleep(0.03 if n == 7 else 0.0)
        return None if n is None else n * 2

    return slow


@pytest.fixture(scope="module")
def job(spark):
    rows = [(i, i % 3, i) for i in range(30)] + [(99, None, None)]
    source = LineageFrame.source(spark.createDataFrame(rows, "id int, g int, v int").repartition(4), "numbers", ["id"])
    first = taps.tap(source, slow_function(), "v", "double", "int")
    sums = first.frame.aggregate(["g"], F.sum("double").alias("s"))
    second = taps.tap(sums, lambda s: s, "s", "s2", "bigint")
    return first, second, second.frame.aggregate([], F.max("s2").alias("largest"))


def test_times_are_written_once_and_sum_up(job):
    first, second, _ = job
    for tap in (first, second):
        once, twice = sorted(map(str, tap.records.collect())), sorted(map(str, tap.records.collect()))
        assert once == twice
        shares = {r["task"]: r for r in tap.records.groupBy("task").agg(F.sum("share_us").alias("s"), F.sum("inputs").alias("n"), F.sum("spent_us").alias("t")).collect()}
        for r in tap.tasks.collect():
            if r["records"]:
                own = shares[r["task"]]
                assert own["s"] == pytest.approx(r["rest_us"]) and own["n"] == r["inputs"] and own["t"] == pytest.approx(r["spent_us"])
    assert {r["id"]["g"]: r["inputs"] for r in second.records.collect()} == {0: 10, 1: 10, 2: 10, None: 1}
    assert {r["id"]["id"]: r["double"] for r in first.frame.df.select(F.col(ID).alias("id"), "double").collect()} == {**{i: 2 * i for i in range(30)}, 99: None}


def test_carried_ranked_and_replayed(job):
    first, second, top = job
    carried, traced = latency.carried_latency(top).first()["latency"], latency.trace_latency(top).first()["latency"]
    assert carried == pytest.approx(traced) and carried >= 30_000
    slowest = latency.take_slowest(latency.removal(top, "numbers"), 1).first()
    assert slowest["id"]["id"] == 7 and slowest["impact"] > 10_000
    kept = first.frame.stage.origin.where(f"{ID}.id <> 7")
    again = top.rerun({"numbers": kept})
    assert latency.carried_latency(again).first()["latency"] < carried - 10_000
    assert {r["id"]["id"] for r in trace(again).back_to_sources().ids("numbers").collect()} == {*range(30), 99} - {7}


def test_taps_without_rows_or_capture(spark):
    none = spark.createDataFrame([], "id int, g int, v int")
    tap = taps.tap(LineageFrame.source(none, "none", ["id"]), slow_function(), "v", "double", "int")
    assert tap.frame.df.count() == 0 and tap.records.count() == 0
    plain = taps.tap(LineageFrame.source(spark.range(3).withColumn("v", F.lit(1)), "r", ["id"], capture=False), slow_function(), "v", "double", "int")
    assert plain.records is None and [r["double"] for r in plain.frame.df.collect()] == [2, 2, 2]


def test_recorded_log_counts_records_and_leaves_others_out(spark):
    with metrics.recorded(spark, "10m") as log:
        spark.range(0, 1000, 1, 5).repartition(7, "id").write.format("noop").mode("overwrite").save()
        spark.range(10).repartition(2).write.format("noop").mode("overwrite").save()
    spark.range(5000).repartition(3).write.format("noop").mode("overwrite").save()
    sums = log.tasks().agg(F.sum("shuffle_write_records").alias("w"), F.sum("shuffle_read_records").alias("r"), F.countDistinct("stage").alias("n")).first()
    assert (sums["w"], sums["r"]) == (1010, 1010) and sums["n"] == 4
    assert metrics.event_log_metrics(spark, log.path, "another group").count() == 0
    assert {r["stage"] for r in metrics.stragglers(log.tasks(), ["run_ms"]).select("stage").distinct().collect()} == {r["stage"] for r in log.tasks().select("stage").distinct().collect()}


def test_a_log_that_a_session_wrote(tmp_path):
    """A session of its own writes a rolling log; its files are read back by parts."""
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {str(__file__.rsplit('/', 2)[0])!r})
from tidemark.session import local_session
spark = local_session(2, 'log', **{{'spark.eventLog.enabled': 'true', 'spark.eventLog.dir': 'file://{tmp_path}', 'spark.eventLog.rolling.enabled': 'true', 'spark.eventLog.compress': 'false', 'spark.driver.memory': '1g'}})
spark.range(0, 500, 1, 3).repartition(4, 'id').write.format('noop').mode('overwrite').save()
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    spark = local_session()
    tasks = metrics.event_log_metrics(spark, f"file://{tmp_path}").collect()
    assert sum(r["shuffle_write_records"] for r in tasks) == 500 == sum(r["shuffle_read_records"] for r in tasks)
    assert all(r["run_ms"] >= 0 and r["cpu_ns"] > 0 for r in tasks) and len(metrics.EVENT_METRICS) == 19
    names = {p.name.split("_")[0] for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert "events" in names


def test_counters_of_a_failed_attempt_are_zero(spark, tmp_path):
    end = {"Event": "SparkListenerTaskEnd", "Stage ID": 4, "Task Info": {"Index": 2, "Attempt": 1}}
    (tmp_path / "log").write_text(json.dumps(end, separators=(",", ":")) + "\n{\"Event\":\"Other\"}\n")
    row = metrics.event_log_metrics(spark, str(tmp_path)).first().asDict()
    assert (row["stage"], row["partition"], row["attempt"]) == (4, 2, 1) and not any(row[c] for c in metrics.EVENT_METRICS)


# ---- sequential patterns ------------------------------------------------------------------------


def holds(sequence, pattern) -> bool:
    at = 0
    for element in pattern:
        while at < len(sequence) and not set(element) <= sequence[at]:
            at += 1
        if at == len(sequence):
            return False
        at += 1
    return True


def by_growth(sequences, least, max_length):
    """Patterns by trying all items behind and beside, on whole sequences."""
    items = sorted({i for s in sequences for e in s for i in e})
    found, front = {}, [((i,),) for i in items]
    while front:
        after = []
        for p in front:
            n = sum(holds(s, p) for s in sequences)
            if n >= least:
                found[p] = n
                if sum(map(len, p)) < max_length:
                    after += [(*p, (i,)) for i in items] + [(*p[:-1], (*p[-1], i)) for i in items if i > p[-1][-1]]
        front = after
    return found


def test_patterns_of_sets_equal_brute_force_and_the_library(spark):
    rng = random.Random(3)
    sequences = [[set(rng.sample("abcd", rng.choice([1, 1, 2, 3]))) for _ in range(rng.randint(1, 7))] for _ in range(14)]
    rows = [(s, p, i) for s, elements in enumerate(sequences) for p, e in enumerate(elements) for i in e]
    events = spark.createDataFrame([*rows, rows[0], (None, 1, "a"), (1, None, "a"), (1, 2, None)], "seq int, pos int, item string").repartition(3)
    for share, longest in ((0.3, 10), (0.5, 3)):
        found = {tuple(map(tuple, r["pattern"])): r["n"] for r in sequential_patterns(events, "seq", "pos", "item", share, longest).collect()}
        assert found == by_growth(sequences, share * 14, longest)
        lists = spark.createDataFrame([([sorted(e) for e in s],) for s in sequences], "sequence array<array<string>>")
        model = PrefixSpan(minSupport=share, maxPatternLength=longest).findFrequentSequentialPatterns(lists).collect()
        assert found == {tuple(tuple(sorted(e)) for e in r["sequence"]): r["freq"] for r in model}
    assert max(sum(map(len, p)) for p in by_growth(sequences, 0.3 * 14, 10)) >= 4


def test_patterns_reach_the_length_limit_and_stop(spark):
    rows = [(s, p, "x") for s in range(3) for p in range(14)]
    events = spark.createDataFrame(rows, "seq int, pos int, item string")
    found = {len(r["pattern"]): r["n"] for r in sequential_patterns(events, "seq", "pos", "item", 1.0).collect()}
    assert found == {n: 3 for n in range(1, 11)}
    assert sequential_patterns(events.limit(0), "seq", "pos", "item", 0.5).count() == 0


def test_whole_sequences_of_the_tables_equal_brute_force(spark, tables):
    steps = user_steps(tables)
    sequences: dict = {}
    for r in sorted(steps.collect(), key=lambda r: (r["user_id"], r["step"])):
        sequences.setdefault(r["user_id"], []).append({r["item"]})
    found = {tuple(e[0] for e in r["pattern"]): r["n"] for r in sequential_patterns(steps, "user_id", "step", "item", 0.6).collect()}
    assert found == {tuple(e[0] for e in p): n for p, n in by_growth(list(sequences.values()), 0.6 * len(sequences), 10).items()}
    assert len(found) > 30 and max(map(len, found)) >= 2
    assert sum(len(s) for s in sequences.values()) == tables.events.count()
