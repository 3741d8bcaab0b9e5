"""Laws of lineage and of cost along it, on small hand-made tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.lineage import debug, latency, metrics, store
from tidemark.lineage.frame import ID, DuplicateIds, LineageFrame, unpivoted_edges
from tidemark.lineage.trace import trace

LINES = [
    "a quick brown fox", "the lazy dog", "a dog and a fox", "", "the end of the line",
    "Vfasonfdsojfanjfosanfsaojfjasoidasjmdosjaoidjsaiodjasojoiasnvjdsfnasoidjsaiodjasoidjaoisdjsaonsajdjasiodjsaoi",
    "Very short",
]


@pytest.fixture(scope="module")
def text(spark):
    rows = [(i, s, float(len(s) + 1)) for i, s in enumerate(LINES)]
    return LineageFrame.source(spark.createDataFrame(rows, "line int, text string, cost double"), "text", ["line"], "cost")


def word_count(text):
    return text.flat_map(F.split("text", " "), "word").filter("word <> ''").aggregate(["word"], F.count("*").alias("n"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_grep_one_step(text):
    found = text.filter(F.col("text").contains("dog"))
    ids = trace(found).filter("id.line = 1")
    assert rows(ids.go_back().ids().select("id.*")) == [(1,)]
    assert [r.text for r in ids.show().collect()] == ["the lazy dog"]


def test_word_count_back_and_forward(text):
    counts = word_count(text)
    dog = trace(counts).filter("id.word = 'dog'")
    lines = dog.go_back().go_back()
    assert rows(lines.ids().select("id.*")) == [(1,), (2,)]
    forward = lines.go_next().go_next()
    words = {r[0] for r in rows(forward.ids().select("id.*"))}
    assert words == set("the lazy dog a and fox".split())


def test_average_length_error(text):
    """A seeded long word spoils the mean of its first letter; its line is found."""
    letters = text.flat_map(F.split("text", " "), "word").filter("word <> ''").map(
        F.substring("word", 1, 1).alias("letter"), F.length("word").alias("size"))
    means = letters.aggregate(["letter"], F.avg("size").alias("mean"))
    suspects = trace(means).filter("mean > 50").back_to_sources()
    assert rows(suspects.ids("text").select("id.*")) == [(5,), (6,)]
    shown = trace(means).filter("mean > 50").go_back().show()
    assert sorted(r["size"] for r in shown.collect()) == [4, 109]


def test_back_trace_rebuilds_its_outputs(text):
    counts = word_count(text)
    chosen = trace(counts).filter("n >= 2")
    whole = {r.word: r.n for r in counts.values().collect()}
    again = {r.word: r.n for r in chosen.replay().values().collect()}
    wanted = [r[0] for r in rows(chosen.ids().select("id.*"))]
    assert wanted and all(again[w] == whole[w] for w in wanted)


def test_forward_of_back_contains_start(text):
    counts = word_count(text)
    start = trace(counts).filter("n = 1")
    back = start.go_back().go_back().go_next().go_next()
    assert set(rows(start.ids().select("id.*"))) <= set(rows(back.ids().select("id.*")))


def test_join_names_both_sides(spark, text):
    more = LineageFrame.source(spark.createDataFrame([("dog", 1), ("fox", 2)], "word string, rank int"), "ranks", ["word"])
    joined = text.flat_map(F.split("text", " "), "word").join(more, ["word"])
    sides = unpivoted_edges(joined)
    assert [e.count() for e in sides] == [4, 4]
    behind = trace(joined).filter("rank = 1").back_to_sources()
    assert rows(behind.ids("ranks").select("id.*")) == [("dog",)]
    assert rows(behind.ids("text").select("id.*")) == [(1,), (2,)]


def test_outer_join_has_no_edge_for_the_missing_side(spark, text):
    more = LineageFrame.source(spark.createDataFrame([(1, "x"), (99, "y")], "line int, mark string"), "marks", ["line"])
    joined = text.map("line", "text").join(more, ["line"], "left")
    left, right = joined.inputs()
    assert left.count() == len(LINES) and right.count() == 1


def test_null_group_keys_are_traced(spark):
    rows_ = spark.createDataFrame([(1, None), (2, None), (3, "x")], "k int, g string")
    grouped = LineageFrame.source(rows_, "t", ["k"]).aggregate(["g"], F.count("*").alias("n"))
    back = trace(grouped).filter("g IS NULL").go_back()
    assert rows(back.ids().select("id.*")) == [(1,), (2,)]


def test_filter_after_aggregate_drops_its_edges(text):
    frequent = word_count(text).filter("n >= 2")
    outputs = {r.out_id.word for r in frequent.inputs()[0].collect()}
    assert outputs == {"a", "the", "dog", "fox"}


def test_duplicate_ids_are_refused(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(DuplicateIds):
        LineageFrame.source(df, "t", ["k"])


def test_capture_off_leaves_no_trace(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b")], "k int, text string")
    plain = LineageFrame.source(df, "t", ["k"], capture=False)
    out = plain.flat_map(F.split("text", " "), "word").aggregate(["word"], F.count("*").alias("n"))
    assert out.df.columns == ["word", "n"] and rows(out.df) == [("a", 1), ("b", 2)]
    assert ID not in out.df.columns


def test_carried_latency_equals_traced(text):
    two = word_count(text).map("word", "n", cost="5.0").aggregate([F.length("word").alias("size")], F.sum("n").alias("n"))
    carried = {tuple(r.id): r.latency for r in latency.carried_latency(two).collect()}
    traced = {tuple(r.id): r.latency for r in latency.trace_latency(two).collect()}
    assert carried.keys() == traced.keys()
    assert all(abs(carried[k] - traced[k]) < 1e-9 for k in carried)


def test_latency_is_spread_over_elements(text):
    even = text.flat_map(F.split("text", " "), "word").inputs()[0].groupBy("in_id").agg(F.sum("latency").alias("s"))
    assert {r.in_id.line: round(r.s, 6) for r in even.collect()} == {i: float(len(s) + 1) for i, s in enumerate(LINES)}
    first = text.flat_map(F.split("text", " "), "word", split="iterator").inputs()[0]
    assert all(r.latency == 0 for r in first.where("out_id.pos > 0").collect())


def fold(a, b):
    """The pairwise merge whose closed form the library uses."""
    slow, fast = (a, b) if (a[0], -a[2]) > (b[0], -b[2]) else (b, a)
    rm = max(slow[1], fast[1] if fast[2] == slow[2] else fast[0])
    return (slow[0], rm, slow[2], False)


def test_removal_closed_form_equals_pairwise_merges(spark):
    rng = random.Random(7)
    data, wanted = [], {}
    for group in range(400):
        members = []
        for _ in range(rng.randint(1, 7)):
            lat = rng.random() * 100
            destructive = rng.random() < 0.5
            members.append((lat, 0.0 if destructive else lat * rng.random(), rng.randint(0, 4), destructive))
        data += [(group, *m) for m in members]
        pool = list(members)
        while len(pool) > 1:  # any merge tree
            a = pool.pop(rng.randrange(len(pool)))
            b = pool.pop(rng.randrange(len(pool)))
            pool.append(fold(a, b))
        wanted[group] = pool[0]
    df = spark.createDataFrame(data, "out_id int, latency double, rm_latency double, slowest int, destructive boolean")
    got = {r.out_id: (r.latency, r.rm_latency, r.slowest, r.destructive) for r in latency.merge_states(df, "out_id").collect()}
    assert got == wanted


def test_removal_through_two_aggregates(spark):
    """The saving that is claimed for the slowest record is what a run without it shows."""
    rng = random.Random(3)
    items = [(i, i % 17, rng.random() * 100) for i in range(200)]
    src = LineageFrame.source(spark.createDataFrame(items, "k int, g int, c double"), "items", ["k"], "c")

    def job(f):
        return f.aggregate(["g"], F.count("*").alias("n")).map((F.col("g") % 3).alias("h"), "n", cost="2.0").aggregate(["h"], F.sum("n").alias("n"))

    state = latency.removal(job(src), "items")
    worst = latency.take_slowest(state, 1).first()
    less = spark.createDataFrame([r for r in items if r[0] != worst.id.k], "k int, g int, c double")
    again = job(LineageFrame.source(less, "items", ["k"], "c"))
    key = state.where(F.col("slowest.k") == worst.id.k).first()
    after = {r.id.h: r.latency for r in latency.trace_latency(again).collect()}
    assert abs(after[key.id.h] - key.rm_latency) < 1e-9
    assert abs(worst.impact - (key.latency - key.rm_latency)) < 1e-9


def test_stored_lineage_traces_alike(spark, text, tmp_path):
    counts = word_count(text)
    store.save(counts, str(tmp_path), "app")
    again = store.load(spark, str(tmp_path), "app")
    a = trace(counts).filter("id.word = 'fox'").back_to_sources().ids("text")
    b = trace(again).filter("id.word = 'fox'").back_to_sources().ids("text")
    assert rows(a.select("id.*")) == rows(b.select("id.*")) == [(0,), (2,)]
    assert rows(latency.trace_latency(again).select("id.*", F.round("latency", 9))) == rows(
        latency.trace_latency(counts).select("id.*", F.round("latency", 9)))
    assert "aggregate" in store.print_dependencies(again)


def test_isolate_one_fault(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") == 123, 1e6).otherwise(1.0).alias("v"))

    def job(part, extra):
        return part.groupBy(*extra, "g").agg(F.sum("v").alias("s"))

    found, rounds = debug.isolate(df, ["id"], job, F.col("s") > 1e5)
    assert [r.id for r in found.collect()] == [123]
    assert [r.suspects for r in rounds] == sorted((r.suspects for r in rounds), reverse=True)


def test_isolate_two_faults_that_act_together(spark):
    df = spark.range(64).select("id", F.when(F.col("id").isin(5, 41), 60.0).otherwise(0.0).alias("v"))

    def job(part, extra):
        return part.groupBy(*extra).agg(F.sum("v").alias("s")) if extra else part.agg(F.sum("v").alias("s"))

    found, _ = debug.isolate(df, ["id"], job, F.col("s") > 100, parts=4)
    kept = {r.id for r in found.collect()}
    assert {5, 41} <= kept and len(kept) < 64


def test_percentile_bounds(text):
    lat = latency.trace_latency(word_count(text))
    n = lat.count()
    assert latency.percentile(lat, 0.5).count() == n // 2
    assert latency.percentile(lat, 1.0).count() == n
    with pytest.raises(ValueError):
        latency.percentile(lat, 0.0)


def test_measured_tasks_count_every_row(spark):
    df = spark.range(1000).repartition(4)
    tasks = metrics.measured_tasks(df).collect()
    assert sum(r.records for r in tasks) == 1000 and {r.partition for r in tasks} == {0, 1, 2, 3}


def test_source_that_feeds_two_branches(spark):
    rows = [(i, i % 3, float(i)) for i in range(10)]
    table = LineageFrame.source(spark.createDataFrame(rows, "k bigint, g bigint, v double"), "t", ["k"])
    low, high = table.filter("k < 5").map("g", "v"), table.filter("k >= 5").map("g", F.col("v").alias("w"))
    job = low.join(high, ["g"])
    back = trace(job).back_to_sources()
    assert sorted(r["id"]["k"] for r in back.ids("t").collect()) == list(range(10))
    assert sorted(r["id"]["k"] for r in back.show("t").select("id").distinct().collect()) == list(range(10))

    def values(frame):
        return sorted(tuple(r) for r in frame.values().collect())

    assert values(trace(job).replay()) == values(job) != []


def test_two_sources_of_one_name_are_refused(spark):
    one = LineageFrame.source(spark.range(3).toDF("k"), "t", ["k"])
    two = LineageFrame.source(spark.range(4).toDF("k"), "t", ["k"])
    with pytest.raises(ValueError):
        trace(one.join(two, ["k"]))
