"""Record-level lineage and cost of records over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.lineage import debug, latency, metrics, store, taps
from tidemark.lineage.frame import EDGE, ID, LineageFrame
from tidemark.lineage.trace import input_ids, join_small, trace
from tidemark.operators.ordering import number_copies
from tidemark.registry import query
from tidemark.session import scratch
from tidemark.tables import LINEITEM_KEY, Tables

KEY = ", ".join(LINEITEM_KEY)


# ---- pipelines ----------------------------------------------------------------------------


def line_items(t: Tables, **options) -> LineageFrame:
    """Line items; a record costs its extended price (a deterministic stand-in for time)."""
    options.setdefault("verify", False)  # ln01 checks the key
    return LineageFrame.source(t.lineitem, "lineitem", LINEITEM_KEY, "l_extendedprice", **options)


def orders(t: Tables, cost: str | None = None) -> LineageFrame:
    return LineageFrame.source(
        t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), "orders", ["l_orderkey"], cost,
        verify=False,
    )


def customers(t: Tables) -> LineageFrame:
    df = t.customer.withColumnsRenamed({"c_custkey": "o_custkey", "c_nationkey": "n_nationkey"})
    return LineageFrame.source(df, "customer", ["o_custkey"], verify=False)


def documents(t: Tables, capture: bool = True) -> LineageFrame:
    return LineageFrame.source(
        t.documents, "documents", ["doc_id"], "n_chars", verify=False, capture=capture
    )


def words(t: Tables, split: str = "collection", capture: bool = True) -> LineageFrame:
    return documents(t, capture).flat_map(F.split("text", " "), "word", split=split)


def word_count(t: Tables, capture: bool = True) -> LineageFrame:
    return words(t, capture=capture).filter("word <> ''").aggregate(
        ["word"], F.count("*").alias("n")
    )


def by_supplier(t: Tables) -> LineageFrame:
    return line_items(t).aggregate(["l_suppkey"], F.round(F.sum("l_quantity"), 2).alias("qty"))


def revenue_by_nation(t: Tables) -> LineageFrame:
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    items = line_items(t).map("l_orderkey", revenue.alias("revenue"))
    buyers = orders(t).map("l_orderkey", "o_custkey")
    nation = LineageFrame.source(
        t.nation.select("n_nationkey", "n_name"), "nation", ["n_nationkey"], verify=False
    )
    return (
        items.join(buyers, ["l_orderkey"])
        .join(customers(t).map("o_custkey", "n_nationkey"), ["o_custkey"])
        .join(nation, ["n_nationkey"])
        .aggregate(["n_name"], F.round(F.sum("revenue"), 4).alias("revenue"))
    )


def largest_order_per_customer(t: Tables) -> LineageFrame:
    """Two aggregates in a row: order totals from line items, then the largest per customer."""
    totals = line_items(t).aggregate(["l_orderkey"], F.sum("l_extendedprice").alias("total"))
    return (
        totals.map("l_orderkey", "total", cost="100.0")
        .join(orders(t).map("l_orderkey", "o_custkey"), ["l_orderkey"])
        .aggregate(["o_custkey"], F.round(F.max("total"), 2).alias("largest"))
    )


WORDS = """(SELECT doc_id, n_chars, word, CAST(pos AS INTEGER) AS pos, size FROM (
    SELECT doc_id, n_chars, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS size
    FROM (SELECT doc_id, n_chars, string_split(text, ' ') AS w FROM documents)))"""


# ---- sources and capture ------------------------------------------------------------------


@query("ln01_tag_source", f"SELECT {KEY}, l_extendedprice AS latency FROM lineitem")
def _(t):
    tagged = line_items(t, verify=True)
    return latency.own_costs(tagged).select("id.*", "latency")


@query("ln01_number_copies", """
    SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS copy
    FROM events""")
def _(t):
    return number_copies(t.events.select("event_type", "user_id"))


@query("ln02_tag_collection", """
    SELECT p.position, p.priority, count(*) AS orders
    FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW'))
         AS p(position, priority) JOIN orders ON o_orderpriority = priority GROUP BY 1, 2""")
def _(t):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    listed = LineageFrame.collection(t.spark, [(n,) for n in names], "priority string", "priorities")
    joined = orders(t).map(F.col("o_orderpriority").alias("priority")).join(listed, ["priority"])
    edges = joined.inputs()[1].groupBy(F.col("in_id.position").cast("int").alias("position"))
    return edges.agg(F.first("out_id.right.position").alias("_p"), F.count("*").alias("orders")).join(
        listed.df.select(F.col("position").cast("int"), "priority"), "position"
    ).select("position", "priority", "orders")


@query("ln03_narrow_edges", f"""
    SELECT {KEY}, l_extendedprice + 1 AS latency FROM lineitem WHERE l_returnflag = 'R'""")
def _(t):
    kept = line_items(t).filter("l_returnflag = 'R'").map(
        (F.col("l_extendedprice") * 2).alias("doubled"), cost="1.0"
    )
    return latency.own_costs(kept).select("id.*", "latency")


@query("ln04_flat_map_edges", f"""
    SELECT doc_id AS in_doc, doc_id AS out_doc, pos AS out_pos FROM {WORDS}""")
def _(t):
    edges = words(t).inputs()[0]
    return edges.select(
        F.col("in_id.doc_id").alias("in_doc"), F.col("out_id.src.doc_id").alias("out_doc"),
        F.col("out_id.pos").alias("out_pos"),
    )


@query("ln05_aggregate_edges", f"SELECT l_suppkey AS out_suppkey, {KEY} FROM lineitem")
def _(t):
    edges = by_supplier(t).inputs()[0]
    return edges.select(F.col("out_id.l_suppkey").alias("out_suppkey"), "in_id.*")


def order_lines(t: Tables) -> LineageFrame:
    return line_items(t).map("l_orderkey", "l_returnflag").join(
        orders(t, "o_totalprice").map("l_orderkey", "o_orderstatus"), ["l_orderkey"]
    )


@query("ln06_join_edges", """
    SELECT 0 AS side, count(*) AS edges, CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(l_extendedprice), 2) AS latency
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL
    SELECT 1, count(*), CAST(sum(o_orderkey) AS BIGINT), round(sum(o_totalprice), 2)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    left, right = order_lines(t).inputs()

    def summary(edges, side):
        return edges.agg(
            F.lit(side).alias("side"), F.count("*").alias("edges"),
            F.sum("in_id.l_orderkey").alias("keys"), F.round(F.sum("latency"), 2).alias("latency"),
        )

    return summary(left, 0).union(summary(right, 1))


@query("ln07_cogroup_edges", """
    SELECT o_custkey AS out_key, 0 AS side, o_orderkey AS in_key FROM orders
    UNION ALL SELECT c_custkey, 1, c_custkey FROM customer""")
def _(t):
    grouped = orders(t).cogroup(
        customers(t), "o_custkey", [F.count("*").alias("orders")], [F.max("c_name").alias("name")]
    )
    left, right = grouped.inputs()
    return left.select(
        F.col("out_id.o_custkey").alias("out_key"), F.lit(0).alias("side"), F.col("in_id.l_orderkey").alias("in_key")
    ).union(right.select("out_id.o_custkey", F.lit(1), "in_id.o_custkey"))


def contacts(t: Tables) -> LineageFrame:
    buyers = LineageFrame.source(
        t.customer.select("c_custkey", F.col("c_name").alias("name")), "customer", ["c_custkey"], verify=False
    ).map("name")
    sellers = LineageFrame.source(
        t.supplier.select("s_suppkey", F.col("s_name").alias("name")), "supplier", ["s_suppkey"], verify=False
    ).map("name")
    return buyers.union(sellers)


@query("ln08_union", """
    SELECT 0 AS src, c_custkey AS key, c_name AS name FROM customer
    UNION ALL SELECT 1, s_suppkey, s_name FROM supplier""")
def _(t):
    return contacts(t).with_ids().select(
        "_out_id.src", F.coalesce("_out_id.id_0.c_custkey", "_out_id.id_1.s_suppkey").alias("key"), "name"
    )


@query("ln09_coalesce", "SELECT o_orderkey AS id, o_orderstatus FROM orders")
def _(t):
    merged = orders(t).map("o_orderstatus").coalesce(2)
    return merged.df.select(F.col(f"{ID}.l_orderkey").alias("id"), "o_orderstatus")


@query("ln10_zip", """
    SELECT c.c_custkey, p.p_partkey, s.s_suppkey
    FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer) AS c
    JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) AS p ON c.n = p.n
    JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) AS s ON s.n = p.n""")
def _(t):
    c = LineageFrame.source(t.customer, "customer", ["c_custkey"], verify=False)
    p = LineageFrame.source(t.part, "part", ["p_partkey"], verify=False)
    s = LineageFrame.source(t.supplier, "supplier", ["s_suppkey"], verify=False)
    zipped = c.zip(["c_acctbal", "c_custkey"], (p, [F.desc("p_retailprice"), "p_partkey"]), (s, ["s_suppkey"]))
    return zipped.df.select(
        F.col(f"{ID}.left.left.c_custkey"), F.col(f"{ID}.left.right.p_partkey"), F.col(f"{ID}.right.s_suppkey")
    )


@query("ln11_sort", "SELECT o_orderkey AS id, o_totalprice FROM orders")
def _(t):
    ordered = orders(t).map("o_totalprice").sort(F.desc("o_totalprice"), f"{ID}.l_orderkey")
    return ordered.df.select(F.col(f"{ID}.l_orderkey").alias("id"), "o_totalprice")


@query("ln12_repartition_and_sort", "SELECT o_custkey, count(*) AS n, true AS in_order FROM orders GROUP BY 1")
def _(t):
    placed = orders(t).repartition_and_sort(8, "o_custkey", "o_orderdate", "l_orderkey")
    numbered = placed.df.withColumn("_row", F.monotonically_increasing_id())
    # the row numbers of a customer follow its order dates
    by_row = Window.partitionBy("o_custkey").orderBy("_row")
    checked = numbered.withColumn("_earlier", F.lag("o_orderdate").over(by_row))
    return checked.groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_and(F.col("o_orderdate") >= F.col("_earlier")), F.lit(True)).alias("in_order"),
    )


@query("ln13_capture_off", f"""
    SELECT word, count(*) AS n, false AS has_ids FROM {WORDS} WHERE word <> '' GROUP BY 1""")
def _(t):
    df = word_count(t, capture=False).df
    return df.withColumn("has_ids", F.lit(ID in df.columns))


@query("ln14_results_with_ids", f"""
    SELECT word AS id_word, word, count(*) AS n FROM {WORDS} WHERE word <> '' GROUP BY 1, 2""")
def _(t):
    return word_count(t).with_ids().select(F.col("_out_id.word").alias("id_word"), "word", "n")


# ---- walking ------------------------------------------------------------------------------


@query("ln15_start_trace", "SELECT DISTINCT l_suppkey FROM lineitem")
def _(t):
    return trace(by_supplier(t)).ids().select("id.*")


@query("ln16_filter_trace", """
    SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > (SELECT sum(l_quantity) / count(DISTINCT l_suppkey) FROM lineitem)""")
def _(t):
    items = t.lineitem.agg((F.sum("l_quantity") / F.countDistinct("l_suppkey")).alias("mean"))
    mean = items.first()["mean"]
    return trace(by_supplier(t)).filter(F.col("qty") > mean).ids().select("id.*")


RARE = "n = 1"


@query("ln17_go_back", f"""
    SELECT doc_id, pos FROM {WORDS} WHERE word IN (SELECT word FROM {WORDS} WHERE word <> '' GROUP BY 1 HAVING count(*) = 1)""")
def _(t):
    return trace(word_count(t)).filter(RARE).go_back().ids().select("id.src.doc_id", "id.pos")


@query("ln18_go_next", f"""
    WITH w AS {WORDS}, rare AS (SELECT word FROM w WHERE word <> '' GROUP BY 1 HAVING count(*) = 1),
    docs AS (SELECT DISTINCT doc_id FROM w JOIN rare USING (word))
    SELECT DISTINCT word FROM w JOIN docs USING (doc_id) WHERE word <> ''""")
def _(t):
    down = trace(word_count(t)).filter(RARE).go_back().go_back()
    return down.go_next().go_next().ids().select("id.*")


@query("ln19_back_to_sources", """
    SELECT 'customer' AS source, count(DISTINCT c_custkey) AS ids FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE n_name = 'NATION_7'
    UNION ALL SELECT 'lineitem', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE n_name = 'NATION_7'
    UNION ALL SELECT 'orders', count(DISTINCT o_orderkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE n_name = 'NATION_7'
    UNION ALL SELECT 'nation', 1""")
def _(t):
    behind = trace(revenue_by_nation(t)).filter("id.n_name = 'NATION_7'").back_to_sources()
    counts = [
        ids.agg(F.lit(f.stage.name).alias("source"), F.count("*").alias("ids")) for f, ids in behind.at
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query("ln20_show", f"""
    SELECT DISTINCT doc_id, pos, word FROM {WORDS}
    WHERE word IN (SELECT word FROM {WORDS} WHERE word <> '' GROUP BY 1 HAVING count(*) = 2)""")
def _(t):
    shown = trace(word_count(t)).filter("n = 2").go_back().show()
    return shown.select("id.src.doc_id", "id.pos", "word")


@query("ln21_resume_from_shown", f"""
    SELECT DISTINCT doc_id FROM {WORDS}
    WHERE word IN (SELECT word FROM {WORDS} WHERE word <> '' GROUP BY 1 HAVING count(*) = 2) AND pos > 10""")
def _(t):
    back = trace(word_count(t)).filter("n = 2").go_back()
    late = back.show().where("id.pos > 10")
    return back.resume(late).go_back().ids().select("id.*")


@query("ln22_replay", f"""
    WITH w AS {WORDS}, common AS (SELECT word FROM w WHERE word <> '' GROUP BY 1 HAVING count(*) = 1),
    docs AS (SELECT DISTINCT doc_id FROM w JOIN common USING (word))
    SELECT word, count(*) AS n FROM w JOIN docs USING (doc_id) WHERE word <> '' GROUP BY 1""")
def _(t):
    return trace(word_count(t)).filter(RARE).replay().values()


@query("ln23_join_input", f"""
    SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM {WORDS}
        WHERE word IN (SELECT word FROM {WORDS} WHERE word <> '' GROUP BY 1 HAVING count(*) = 1))""")
def _(t):
    rows = trace(word_count(t)).filter(RARE).source_rows("documents", t.documents, ["doc_id"])
    return rows.select("doc_id", "text")


# ---- storage ------------------------------------------------------------------------------


@query("ln24_store_and_reload", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'""")
def _(t):
    path = scratch(t.spark, "lineage")
    store.save(revenue_by_nation(t), path, "app1")
    again = store.load(t.spark, path, "app1")
    behind = trace(again).filter("id.n_name = 'NATION_3'").back_to_sources()
    return behind.ids("lineitem").select("id.*")


@query("ln25_capped_store", f"""
    SELECT {KEY} FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY {KEY}) AS n FROM lineitem) WHERE n <= 100""")
def _(t):
    kept = store.capped(line_items(t).df, 100, F.pmod("l_suppkey", F.lit(8)))
    return kept.select(f"{ID}.*")


@query("ln26_bounded_edges", f"""
    SELECT l_suppkey AS out_suppkey, {KEY}, l_extendedprice AS latency FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {KEY}) AS n FROM lineitem) WHERE n <= 10""")
def _(t):
    kept = latency.bounded(by_supplier(t).inputs()[0], 10)
    return kept.select(F.col("out_id.l_suppkey").alias("out_suppkey"), "in_id.*", "latency")


@query("ln27_dependencies", """
    WITH s(stage, name, kind, depth, parents) AS (VALUES
        (4, 'lineitem', 'source', 0, ''), (5, 'orders', 'source', 0, ''), (6, 'customer', 'source', 0, ''),
        (7, 'nation', 'source', 0, ''), (3, 'join', 'join', 1, '4,5'), (2, 'join', 'join', 2, '3,6'),
        (1, 'join', 'join', 3, '2,7'), (0, 'aggregate', 'aggregate', 4, '1'))
    SELECT s.*, CASE WHEN depth = 4 THEN (SELECT count(*) FROM nation WHERE n_nationkey IN (
        SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey))
        ELSE 0 END AS records FROM s""")
def _(t):
    root = revenue_by_nation(t)
    rows = [(s, n, k, d, ",".join(map(str, p))) for s, n, k, d, p in store.dependencies(root)]
    tree = t.spark.createDataFrame(rows, "stage int, name string, kind string, depth int, parents string")
    size = root.df.agg(F.count("*").alias("size"))
    return tree.join(size, F.col("depth") == 4, "left").select(
        "stage", "name", "kind", "depth", "parents", F.coalesce("size", F.lit(0)).alias("records")
    )


@query("ln28_input_ids", f"SELECT DISTINCT {KEY} FROM lineitem")
def _(t):
    return input_ids(by_supplier(t)).select("in_id.*")


# ---- cost ---------------------------------------------------------------------------------


@query("ln29_measured_latency")
def _(t):
    from pyspark.sql import types as T

    spaces = metrics.timed(lambda text: text.count(" ") + 1, T.LongType())
    measured = LineageFrame.source(
        t.documents.withColumn("_m", spaces("text")), "documents", ["doc_id"], "_m.elapsed_us", verify=False
    ).map(F.col("_m.value").alias("words"))
    return measured.df.select(f"{ID}.doc_id", "words", F.col("_cost").alias("elapsed_us"))


def count_words(text: str | None) -> int:
    return 0 if text is None else text.count(" ") + 1


def timed_sources(t: Tables) -> tuple[taps.Tap, taps.Tap, LineageFrame]:
    """A user function timed on every document, its results summed up by language and source and timed again, then by language."""
    first = taps.tap(
        LineageFrame.source(t.documents.select("doc_id", "lang", "source", "text"), "documents", ["doc_id"], verify=False),
        count_words, "text", "words", "bigint")
    by_source = first.frame.map("lang", "source", "words").aggregate(["lang", "source"], F.sum("words").alias("words"))
    second = taps.tap(by_source, lambda n: n % 1000, "words", "rest", "bigint")
    return first, second, second.frame.aggregate(["lang"], F.sum("words").alias("words"), F.sum("rest").alias("rest"))


@query("ln29_measured_cost", """
    SELECT doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS words, CAST(1 AS BIGINT) AS inputs, true AS timed, true AS in_cost FROM documents""")
def _(t):
    """Times of records, written once: the record's cost is its time and its share of its task's."""
    first, _, _ = timed_sources(t)
    rows = first.frame.df.select(F.col(ID).alias("id"), "words", F.col("_cost").alias("cost"))
    spent = F.col("spent_us") + F.col("share_us")
    return rows.join(first.records, "id").select(
        "id.doc_id", "words", "inputs", ((F.col("spent_us") > 0) & (F.col("share_us") > 0)).alias("timed"), (F.abs(F.col("cost") - spent) < 1e-6 * spent).alias("in_cost"))


@query("ln29_carried_cost", """
    SELECT lang, CAST(sum(length(text) - length(replace(text, ' ', '')) + 1) AS BIGINT) AS words, count(DISTINCT source) AS sources, true AS as_stored FROM documents GROUP BY 1""")
def _(t):
    """Measured times through two aggregates: the largest carried by the job equals that of the stored edges."""
    _, _, by_lang = timed_sources(t)
    carried = latency.carried_latency(by_lang).withColumnRenamed("latency", "carried")
    stored_edges = latency.trace_latency(by_lang)
    inputs = by_lang.inputs()[0].groupBy(F.col("out_id").alias("id")).agg(F.count("*").alias("sources"))
    rows = by_lang.df.select(F.col(ID).alias("id"), "words")
    same = F.abs(F.col("carried") - F.col("latency")) <= 1e-9 * F.col("carried")
    return rows.join(carried, "id").join(stored_edges, "id").join(inputs, "id").select("id.lang", "words", "sources", (same & (F.col("carried") > 0)).alias("as_stored"))


@query("ln32_measured_stage_time", """
    SELECT lang, source, count(*) AS inputs, true AS shared FROM documents GROUP BY 1, 2""")
def _(t):
    """The measured time of an aggregate's tasks, dealt out to the outputs by their shares of the inputs."""
    _, second, _ = timed_sources(t)
    task = second.tasks.select("task", F.col("inputs").alias("all"), "rest_us")
    wanted = F.col("rest_us") * F.col("inputs") / F.col("all")
    return second.records.join(task, "task").select(
        "id.*", "inputs", ((F.col("share_us") > 0) & (F.abs(F.col("share_us") - wanted) <= 1e-9 * wanted)).alias("shared"))


@query("ln44_measured_slowest")
def _(t):
    """Documents ranked by what their removal would save of the measured time of a language."""
    _, _, by_lang = timed_sources(t)
    return latency.take_slowest(latency.removal(by_lang, "documents"), 10).select("id.*", "latency", "rm_latency", "impact")


@query("ln50_measured_replay", "SELECT count(*) - 1 AS documents FROM documents")
def _(t):
    """The job again without the slowest document."""
    first, _, by_lang = timed_sources(t)
    slowest = latency.take_slowest(latency.removal(by_lang, "documents"), 1).select(F.col("id").alias(ID))
    kept = by_lang.sources()["documents"].stage.origin.join(slowest, ID, "left_anti")
    again = by_lang.rerun({"documents": kept})
    return trace(again).back_to_sources().ids("documents").agg(F.count("*").alias("documents"))


@query("ln30_split_latency", f"""
    SELECT doc_id, pos, round(n_chars / size, 6) AS even, CASE WHEN pos = 0 THEN CAST(n_chars AS DOUBLE) ELSE 0.0 END AS first_only
    FROM {WORDS}""")
def _(t):
    even = words(t).inputs()[0].select("out_id", F.round("latency", 6).alias("even"))
    first = words(t, "iterator").inputs()[0].select("out_id", F.col("latency").alias("first_only"))
    return even.join(first, "out_id").select("out_id.src.doc_id", "out_id.pos", "even", "first_only")


SUPP_PART = "out_id.l_suppkey"


@query("ln31_partition_stats", """
    SELECT l_suppkey % 8 AS partition, count(*) AS num_inputs, count(DISTINCT l_suppkey) AS num_outputs,
           round(sum(l_extendedprice), 2) AS latency FROM lineitem GROUP BY 1""")
def _(t):
    stats = latency.partition_stats(by_supplier(t).inputs()[0], F.pmod(F.col(SUPP_PART), F.lit(8)))
    return stats.withColumn("latency", F.round("latency", 2))


@query("ln32_spread_stage_latency", """
    SELECT l_suppkey, l_suppkey % 8 AS partition, count(*) AS inputs,
           round(1000.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey % 8), 6) AS share
    FROM lineitem GROUP BY 1, 2""")
def _(t):
    spread = latency.spread_stage_latency(
        by_supplier(t).inputs()[0], F.pmod(F.col(SUPP_PART), F.lit(8)), F.lit(1000.0)
    )
    return spread.select(SUPP_PART, "partition", "inputs", F.round("share", 6).alias("share"))


@query("ln33_trace_latency", """
    SELECT o_custkey, max(lat + 100.0) AS latency FROM (
        SELECT l_orderkey, max(l_extendedprice) AS lat FROM lineitem GROUP BY 1)
    JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    return latency.trace_latency(largest_order_per_customer(t)).select("id.*", "latency")


@query("ln33_carried_latency", """
    SELECT o_custkey, max(lat + 100.0) AS latency FROM (
        SELECT l_orderkey, max(l_extendedprice) AS lat FROM lineitem GROUP BY 1)
    JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    return latency.carried_latency(largest_order_per_customer(t)).select("id.*", "latency")


@query("ln34_reduce_with_count", """
    SELECT l_suppkey, max(l_extendedprice) AS latency, count(*) AS inputs FROM lineitem GROUP BY 1""")
def _(t):
    return by_supplier(t).inputs()[0].groupBy("out_id").agg(
        F.max("latency").alias("latency"), F.count("*").alias("inputs")
    ).select("out_id.*", "latency", "inputs")


def customer_latency(t: Tables):
    return latency.trace_latency(largest_order_per_customer(t))


CUSTOMER_LATENCY = """(SELECT o_custkey, max(lat + 100.0) AS latency FROM (
        SELECT l_orderkey, max(l_extendedprice) AS lat FROM lineitem GROUP BY 1)
    JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""


@query("ln35_filter_latency", f"SELECT o_custkey, latency FROM {CUSTOMER_LATENCY} WHERE latency > 90000")
def _(t):
    return customer_latency(t).where("latency > 90000").select("id.*", "latency")


@query("ln36_latencies", f"SELECT latency, count(*) AS n FROM {CUSTOMER_LATENCY} GROUP BY 1")
def _(t):
    return customer_latency(t).groupBy("latency").agg(F.count("*").alias("n"))


@query("ln37_take", f"""
    (SELECT 'slowest' AS kind, o_custkey, latency FROM {CUSTOMER_LATENCY} ORDER BY latency DESC, o_custkey LIMIT 10)
    UNION ALL (SELECT 'fastest', o_custkey, latency FROM {CUSTOMER_LATENCY} ORDER BY latency, o_custkey LIMIT 10)""")
def _(t):
    lat = customer_latency(t)
    return latency.take(lat, 10).select(F.lit("slowest").alias("kind"), "id.*", "latency").union(
        latency.take(lat, 10, ascending=True).select(F.lit("fastest"), "id.*", "latency")
    )


@query("ln38_percentile", f"""
    SELECT o_custkey, latency FROM (SELECT *, row_number() OVER (ORDER BY latency DESC, o_custkey) AS n,
        count(*) OVER () AS c FROM {CUSTOMER_LATENCY}) WHERE n <= floor(0.05 * c)""")
def _(t):
    return latency.percentile(customer_latency(t), 0.05).select("id.*", "latency")


@query("ln39_join_values", f"""
    SELECT o_custkey, latency, round(largest, 2) AS largest FROM {CUSTOMER_LATENCY} JOIN (
        SELECT o_custkey, max(total) AS largest FROM (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)
        JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) USING (o_custkey)""")
def _(t):
    frame = largest_order_per_customer(t)
    values = frame.df.select(F.col(ID).alias("id"), "largest")
    return latency.trace_latency(frame).join(values, "id").select("id.*", "latency", "largest")


@query("ln40_join_application_result", f"""
    SELECT c_custkey, c_name, latency FROM {CUSTOMER_LATENCY} JOIN customer ON o_custkey = c_custkey""")
def _(t):
    lat = customer_latency(t).select(F.col("id.o_custkey").alias("c_custkey"), "latency")
    return lat.join(t.customer.select("c_custkey", "c_name"), "c_custkey")


# ---- removal ------------------------------------------------------------------------------

ORDER_STATE = f"""(SELECT w.l_orderkey, w.lat AS latency, coalesce(r.lat, 0.0) AS rm_latency,
        w.l_linenumber, w.l_partkey, w.l_suppkey, w.l_quantity, w.l_extendedprice, w.c = 1 AS destructive
    FROM (SELECT *, l_extendedprice AS lat, count(*) OVER (PARTITION BY l_orderkey) AS c,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {KEY}) AS n FROM lineitem) AS w
    LEFT JOIN (SELECT l_orderkey, l_extendedprice AS lat,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {KEY}) AS n FROM lineitem) AS r
      ON r.l_orderkey = w.l_orderkey AND r.n = 2 WHERE w.n = 1)"""


def order_totals(t: Tables) -> LineageFrame:
    return line_items(t).aggregate(["l_orderkey"], F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("ln41_removal_state", f"SELECT * FROM {ORDER_STATE}")
def _(t):
    state = latency.removal(order_totals(t), "lineitem")
    return state.select("latency", "rm_latency", "slowest.*", "destructive")


@query("ln42_pass_stage", f"""
    SELECT l_orderkey, latency + 100.0 AS latency, CASE WHEN destructive THEN rm_latency ELSE rm_latency + 100.0 END AS rm_latency,
           destructive FROM {ORDER_STATE}""")
def _(t):
    frame = order_totals(t).map("l_orderkey", "total", cost="100.0")
    return latency.removal(frame, "lineitem").select("id.*", "latency", "rm_latency", "destructive")


@query("ln43_merge_states", f"""
    WITH s AS (SELECT o_custkey, latency + 100.0 AS lat, CASE WHEN destructive THEN 0.0 ELSE rm_latency + 100.0 END AS rm,
            destructive, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
        FROM {ORDER_STATE} JOIN orders ON l_orderkey = o_orderkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY lat DESC, {KEY}) AS n,
            count(*) OVER (PARTITION BY o_custkey) AS c FROM s)
    SELECT o_custkey, max(lat) AS latency, max(CASE WHEN n = 1 THEN rm ELSE lat END) AS rm_latency,
           max(CASE WHEN n = 1 THEN l_orderkey END) AS slow_order, max(c) = 1 AND bool_and(destructive) AS destructive
    FROM r GROUP BY 1""")
def _(t):
    state = latency.removal(largest_order_per_customer(t), "lineitem")
    return state.select(
        "id.*", "latency", "rm_latency", F.col("slowest.l_orderkey").alias("slow_order"), "destructive"
    )


NATION_STATE = """
    WITH e AS (SELECT n_name, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice AS lat
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey
               JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY lat DESC, l_orderkey, l_linenumber,
                                       l_partkey, l_suppkey, l_quantity) AS rn FROM e)
    SELECT w.n_name, w.l_orderkey, w.l_linenumber, w.lat AS latency, r.lat AS rm_latency, round(w.lat - r.lat, 2) AS impact
    FROM r AS w JOIN r ON r.n_name = w.n_name AND r.rn = 2 WHERE w.rn = 1"""


@query("ln44_slowest_inputs", NATION_STATE)
def slowest_inputs(t):
    """The costliest line item per nation of the buyer, and what its removal saves."""
    state = latency.removal(revenue_by_nation(t), "lineitem")
    return latency.impact_by_output(state).select(
        "id.n_name", "slowest.l_orderkey", "slowest.l_linenumber", "latency", "rm_latency",
        F.round("impact", 2).alias("impact"),
    )


@query("ln44_take_slowest", f"""
    SELECT {KEY}, latency, rm_latency, round(latency - rm_latency, 2) AS impact FROM {ORDER_STATE}
    ORDER BY latency - rm_latency DESC, {KEY} LIMIT 20""")
def _(t):
    top = latency.take_slowest(latency.removal(order_totals(t), "lineitem"), 20)
    return top.select("id.*", "latency", "rm_latency", F.round("impact", 2).alias("impact"))


@query("ln45_single_slowest", f"""
    SELECT l_orderkey, l_linenumber, latency, round(latency - greatest(rm_latency, second), 2) AS saving FROM (
        SELECT *, lead(latency) OVER (ORDER BY latency DESC, l_orderkey) AS second,
               row_number() OVER (ORDER BY latency DESC, l_orderkey) AS n FROM {ORDER_STATE}) WHERE n = 1""")
def _(t):
    best = latency.single_slowest(latency.removal(order_totals(t), "lineitem"))
    return best.select("id.l_orderkey", "id.l_linenumber", "latency", F.round("saving", 2).alias("saving"))


@query("ln46_several_slowest", f"""
    SELECT l_suppkey AS out_suppkey, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY n) AS slowest FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {KEY}) AS n FROM lineitem)
    WHERE n <= 3 GROUP BY 1""")
def _(t):
    top = latency.top_inputs(by_supplier(t).inputs()[0], 3)
    listed = F.sort_array(F.collect_list(F.struct("place", "in_id")))
    names = F.transform(listed, lambda s: F.concat_ws(":", s["in_id"]["l_orderkey"], s["in_id"]["l_linenumber"]))
    return top.groupBy("out_id").agg(F.array_join(names, ",").alias("slowest")).select(
        F.col("out_id.l_suppkey").alias("out_suppkey"), "slowest"
    )


# ---- metrics and debugging ----------------------------------------------------------------


def shuffled_items(t: Tables):
    return t.lineitem.select("l_suppkey", "l_extendedprice").repartition(8, "l_suppkey")


@query("ln47_task_metrics")
def _(t):
    return metrics.measured_tasks(shuffled_items(t))


@query("ln48_stragglers")
def _(t):
    return metrics.stragglers(metrics.measured_tasks(shuffled_items(t)), ["records", "bytes", "wall_us"])


def recorded_tasks(t: Tables):
    """Counters of all tasks of a shuffled aggregate over the line items, from the event log of its own jobs."""
    per_order = t.lineitem.repartition("l_suppkey").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    with metrics.recorded(t.spark) as log:
        per_order.write.format("noop").mode("overwrite").save()
    return log.tasks()


@query("ln47_event_log")
def _(t):
    return recorded_tasks(t)


@query("ln47_event_log_records", "SELECT count(*) AS read_records, true AS shuffled, true AS all_read, true AS timed FROM lineitem")
def _(t):
    sums = recorded_tasks(t).agg(
        F.sum("input_records").alias("read_records"), F.sum("shuffle_write_records").alias("written"), F.sum("shuffle_read_records").alias("fetched"),
        F.sum("shuffle_write_bytes").alias("bytes"), F.sum(F.col("shuffle_local_bytes") + F.col("shuffle_remote_bytes")).alias("fetched_bytes"),
        F.sum("cpu_ns").alias("cpu_ns"))
    return sums.select(
        "read_records", (F.col("written") >= F.col("read_records")).alias("shuffled"),
        ((F.col("written") == F.col("fetched")) & (F.col("bytes") == F.col("fetched_bytes"))).alias("all_read"), (F.col("cpu_ns") > 0).alias("timed"))


@query("ln48_event_log_stragglers")
def _(t):
    """Tasks far above the median of their stage in time, GC and bytes, for every stage of the log."""
    return metrics.stragglers(recorded_tasks(t), ["run_ms", "gc_ms", "shuffle_write_bytes", "shuffle_local_bytes", "input_bytes"])


FAULT = "total > 600000"


@query("ln49_isolate_faulty_inputs", f"""
    SELECT {KEY} FROM lineitem WHERE l_orderkey IN (
        SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING round(sum(l_extendedprice), 2) > 600000)""")
def _(t):
    behind = trace(order_totals(t)).filter(FAULT).back_to_sources()
    return behind.ids("lineitem").select("id.*")


@query("ln50_removal_check", f"""
    WITH top AS (SELECT {KEY} FROM {ORDER_STATE} ORDER BY latency - rm_latency DESC, {KEY} LIMIT 1)
    SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, max(l_extendedprice) AS latency
    FROM lineitem AS l WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.l_orderkey = l.l_orderkey
        AND top.l_linenumber = l.l_linenumber AND top.l_partkey = l.l_partkey AND top.l_suppkey = l.l_suppkey
        AND top.l_quantity = l.l_quantity AND top.l_extendedprice = l.l_extendedprice) GROUP BY 1""")
def _(t):
    frame = order_totals(t)
    slowest = latency.take_slowest(latency.removal(frame, "lineitem"), 1).select(F.col("id").alias(ID))
    kept = frame.sources()["lineitem"].stage.origin.join(slowest, ID, "left_anti")
    again = frame.rerun({"lineitem": kept})
    return again.df.select("l_orderkey", "total", F.col("_total").alias("latency"))


def heaviest_price(t: Tables) -> float:
    return t.lineitem.agg(F.max("l_extendedprice")).first()[0]


def search(t: Tables):
    """Which line item makes a supplier's largest price reach the overall maximum?"""
    limit = heaviest_price(t)

    def job(rows, extra):
        return rows.groupBy(*extra, "l_suppkey").agg(F.max("l_extendedprice").alias("largest"))

    return debug.isolate(t.lineitem, list(LINEITEM_KEY), job, F.col("largest") >= limit)


@query("ln51_localization_progress")
def _(t):
    _, rounds = search(t)
    return t.spark.createDataFrame(
        [(r.number, r.suspects, r.parts, r.failing_part, r.seconds) for r in rounds],
        "round int, suspects bigint, parts int, failing_part int, seconds double",
    )


@query("ln52_delta_debugging", f"""
    SELECT {KEY} FROM lineitem ORDER BY l_extendedprice DESC, {KEY} LIMIT 1""")
def _(t):
    found, _ = search(t)
    return found.select(*LINEITEM_KEY)


@query("ln53_test_predicate", """
    SELECT l_orderkey, count(*) > 6 AND sum(l_quantity) > 200 AS faulty FROM lineitem GROUP BY 1""")
def _(t):
    test = (F.col("n") > 6) & (F.col("qty") > 200)
    counted = line_items(t).aggregate(["l_orderkey"], F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    return counted.map("l_orderkey", test.alias("faulty")).values()


@query("ln54_join_small_trace", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_suppkey IN (
        SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) > (SELECT count(*) / count(DISTINCT l_suppkey) FROM lineitem))""")
def _(t):
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    ids = counts.join(mean, F.col("n") > F.col("mean")).select("l_suppkey")
    return join_small(t.lineitem, ids, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_extendedprice")
