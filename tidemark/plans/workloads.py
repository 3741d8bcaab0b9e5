"""End-to-end workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.graph.algorithms import contribution_rank
from tidemark.lineage.frame import LineageFrame
from tidemark.lineage.trace import trace
from tidemark.operators.ordering import with_index
from tidemark.plans.lineage import documents
from tidemark.registry import query, same

# a line with any of these characters is no prose: fixed values
MARKS = "[><*=#+:{}/~0-9-]"
LINES = f"(SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row_no FROM documents)"
KEPT_WORDS = f"(SELECT doc_id, row_no, unnest(string_split(line, ' ')) AS word FROM {LINES} WHERE NOT regexp_matches(line, '{MARKS}'))"


def prose_words(t) -> LineageFrame:
    lines = documents(t).flat_map(F.split("text", "\n"), "line", stage="lines")
    return lines.filter(~F.col("line").rlike(MARKS)).flat_map(F.split("line", " "), "word", stage="words")


@query("wl01_word_count", f"SELECT word, count(*) AS n FROM {KEPT_WORDS} WHERE word <> '' GROUP BY 1")
def _(t):
    return prose_words(t).filter("word <> ''").aggregate(["word"], F.count("*").alias("n")).values()


@query("wl01_word_count_trace", f"""
    WITH w AS {KEPT_WORDS}, top AS (SELECT word FROM w WHERE word <> '' GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 1)
    SELECT DISTINCT w.doc_id, w.row_no::INTEGER AS line FROM w JOIN top USING (word)""")
def _(t):
    """The lines behind the most frequent word."""
    counts = prose_words(t).filter("word <> ''").aggregate(["word"], F.count("*").alias("n"))
    top = counts.df.orderBy(F.desc("n"), "word").limit(1).select("word").first()["word"]  # one row
    behind = trace(counts).filter(F.col("id.word") == top).go_back().go_back()
    return behind.ids().select("id.src.doc_id", F.col("id.pos").alias("line"))


@query("wl02_rating_histogram", """
    SELECT bin, count(*) AS n FROM (SELECT floor(avg(l_quantity) / 5) / 2 AS bin FROM lineitem GROUP BY l_partkey) GROUP BY 1""")
def _(t):
    """Average rating per item in half steps, then the number of items per step."""
    means = t.lineitem.groupBy("l_partkey").agg(F.avg(F.col("l_quantity") / 10).alias("rating"))
    return means.groupBy((F.floor(F.round(F.col("rating") * 2, 9)) / 2).alias("bin")).agg(F.count("*").alias("n"))


@query("wl03_inverted_index", """
    SELECT word, doc_id // 512 AS block, string_agg(doc_id, ',' ORDER BY doc_id) AS documents, count(*) AS n FROM (
        SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2""")
def _(t):
    """Posting lists in blocks of at most 512 documents: a word of every document has many short
    lists, in many tasks, in place of one long list."""
    pairs = t.documents.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).where("word <> ''")
    # the pairs are distinct, so lists made before the shuffle would save nothing
    placed = pairs.withColumn("block", F.expr("doc_id div 512")).repartition("word", "block")
    postings = F.sort_array(F.collect_list("doc_id"))
    return placed.groupBy("word", "block").agg(
        F.array_join(postings.cast("array<string>"), ",").alias("documents"), F.count("*").alias("n"))


@query("wl04_term_vector", """
    SELECT source, word, count(*) AS n FROM (SELECT source, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2 HAVING count(*) > 10""")
def _(t):
    """Term frequencies per host as (host, word, n): a host's vector is spread over its words."""
    words = t.documents.select("source", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return words.groupBy("source", "word").agg(F.count("*").alias("n")).where("n > 10")


@query("wl05_average_by_grade", "SELECT c_nationkey AS grade, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    grades = LineageFrame.source(t.customer, "students", ["c_custkey"], verify=False)
    return grades.map(F.col("c_nationkey").alias("grade"), "c_acctbal").aggregate(
        ["grade"], F.round(F.avg("c_acctbal"), 6).alias("mean"), F.count("*").alias("n")).values()


@query("wl06_weather_delta", """
    WITH x AS (SELECT o_custkey % 50 AS state, o_orderdate AS d, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 304.8 ELSE o_totalprice END AS mm FROM orders)
    SELECT state, key, round(max(mm) - min(mm), 4) AS delta FROM (
        SELECT state, strftime(d, '%m/%d') AS key, mm FROM x UNION ALL SELECT state, strftime(d, '%Y'), mm FROM x) GROUP BY 1, 2""")
def _(t):
    """Largest change per state and day, and per state and year: one scan, two keys per record."""
    mm = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 304.8).otherwise(F.col("o_totalprice"))
    keys = F.array(F.date_format("o_orderdate", "MM/dd"), F.date_format("o_orderdate", "yyyy"))
    keyed = t.orders.select((F.col("o_custkey") % 50).alias("state"), F.explode(keys).alias("key"), mm.alias("mm"))
    return keyed.groupBy("state", "key").agg(F.round(F.max("mm") - F.min("mm"), 4).alias("delta"))


HREFS = """(SELECT DISTINCT url AS src, h AS dst FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages)
    UNION SELECT h, url FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages))"""


def _rank_sql(rounds: int) -> str:
    parts = [f"e AS MATERIALIZED {HREFS}", "d AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY 1)", "r0 AS MATERIALIZED (SELECT src AS id, 1.0::DOUBLE AS rank FROM d)"]
    parts += [
        f"r{i + 1} AS MATERIALIZED (SELECT e.dst AS id, 0.15 + 0.85 * sum(rank / deg) AS rank FROM e JOIN r{i} ON id = e.src JOIN d ON d.src = e.src GROUP BY 1)"
        for i in range(rounds)]
    return f"WITH {', '.join(parts)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("wl07_page_rank", _rank_sql(4))
def _(t):
    """Pages and the links on them; each link also leads back."""
    there = t.pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("dst"))
    both = there.union(there.select("dst", "src"))
    return contribution_rank(both, 4).withColumn("rank", F.round("rank", 9))


# ---- reporting query shapes on the star schema ------------------------------------------------

same("wl08_channel_union", """
    SELECT channel, id, round(sum(sales), 2) AS sales, round(sum(lost), 2) AS lost FROM (
        SELECT 'customer' AS channel, o_custkey AS id, o_totalprice AS sales, 0.0 AS lost FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'supplier' AS channel, l_suppkey AS id, l_extendedprice AS sales, l_extendedprice * l_discount AS lost FROM lineitem WHERE l_returnflag = 'R') AS x
    GROUP BY ROLLUP (channel, id)""".replace("0.0 AS lost", "CAST(0.0 AS DOUBLE) AS lost"))

same("wl08_exists_or", """
    SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000)
       OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 450000)
    GROUP BY c_mktsegment""")

same("wl08_share_window", """
    SELECT p_type, p_brand, round(sum(l_extendedprice), 2) AS revenue,
           round(sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_type), 6) AS share
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY p_type, p_brand""")

same("wl08_intersect", """
    SELECT count(*) AS n FROM (
        SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
        INTERSECT SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'
        INTERSECT SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P') AS x""")

same("wl08_except", """
    SELECT count(*) AS n FROM (
        SELECT DISTINCT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW'
        EXCEPT SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT') AS x""")

same("wl08_cumulative_full_join", """
    WITH a AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, year(o_orderdate)),
         b AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey, year(o_orderdate)),
         x AS (SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(a.y, b.y) AS INT) AS y, a.v AS av, b.v AS bv FROM a FULL OUTER JOIN b ON a.k = b.k AND a.y = b.y)
    SELECT k, y, round(sum(av) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS a_total,
           round(sum(bv) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS b_total FROM x""")

same("wl08_overlap_counts", """
    WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
         b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
    SELECT count(CASE WHEN a.k IS NOT NULL AND b.k IS NULL THEN 1 END) AS only_a, count(CASE WHEN a.k IS NULL AND b.k IS NOT NULL THEN 1 END) AS only_b,
           count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 END) AS both FROM a FULL OUTER JOIN b ON a.k = b.k""")

same("wl08_rollup_rank", """
    SELECT * FROM (
        SELECT p_type, p_brand, y, round(revenue, 2) AS revenue, CAST(rank() OVER (PARTITION BY p_type ORDER BY round(revenue, 2) DESC) AS INT) AS place FROM (
            SELECT p_type, p_brand, CAST(year(l_shipdate) AS INT) AS y, sum(l_extendedprice * l_quantity) AS revenue
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_type, p_brand, year(l_shipdate))) AS x) AS z
    WHERE place <= 20""")

same("wl08_grouping_hierarchy", """
    SELECT r_name, n_name, round(sum(s_acctbal), 2) AS balance, CAST(grouping(r_name) + grouping(n_name) AS INT) AS level
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")

same("wl08_day_pivot", """
    SELECT l_suppkey, round(sum(CASE WHEN dayofweek(CAST(l_shipdate AS DATE)) + {shift} = 1 THEN l_extendedprice END), 2) AS sunday,
           round(sum(CASE WHEN dayofweek(CAST(l_shipdate AS DATE)) + {shift} = 2 THEN l_extendedprice END), 2) AS monday FROM lineitem GROUP BY l_suppkey""".replace(
    "dayofweek(CAST(l_shipdate AS DATE)) + {shift} = 1", "CAST(l_shipdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 490000)").replace(
    "dayofweek(CAST(l_shipdate AS DATE)) + {shift} = 2", "month(l_shipdate) = 2").replace("sunday", "on_peak_days").replace("monday", "in_february"))

same("wl08_above_group_average", """
    WITH r AS (SELECT o_custkey AS c, c_nationkey AS s, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY o_custkey, c_nationkey)
    SELECT c_name FROM r AS a JOIN customer ON c_custkey = c WHERE total > (SELECT avg(total) * 1.2 FROM r AS b WHERE a.s = b.s)""")

same("wl08_year_over_year", """
    WITH y AS (SELECT l_suppkey AS s, year(l_shipdate) AS y, sum(l_extendedprice) AS v FROM lineitem GROUP BY l_suppkey, year(l_shipdate))
    SELECT a.s, CAST(a.y AS INT) AS y, round(b.v / a.v, 9) AS growth FROM y AS a JOIN y AS b ON a.s = b.s AND b.y = a.y + 1 WHERE b.v > a.v""")

same("wl08_conditional_counts", """
    SELECT count(CASE WHEN l_quantity BETWEEN 1 AND 20 THEN 1 END) AS low, count(CASE WHEN l_quantity BETWEEN 21 AND 40 THEN 1 END) AS middle,
           round(avg(CASE WHEN l_quantity > 40 THEN l_extendedprice END), 4) AS high_mean FROM lineitem""")

same("wl08_return_reasons", """
    SELECT n_name, p_brand, count(*) AS returned, round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 4) AS price
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'R' GROUP BY n_name, p_brand ORDER BY returned DESC, n_name, p_brand LIMIT 100""")

same("wl08_pricing_summary", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS sum_charge, round(avg(l_discount), 9) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY l_returnflag, l_linestatus""")

same("wl08_shipping_priority", """
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")

same("wl09_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
same("wl09_aggregate_by_prefix", "SELECT substr(s_name, 1, 17) AS prefix, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY substr(s_name, 1, 17)")
same("wl09_join_top", """
    SELECT s_name, round(sum(l_extendedprice), 2) AS revenue, round(avg(p_size), 6) AS size
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE l_shipdate BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY s_name ORDER BY revenue DESC, s_name LIMIT 10""")
same("wl09_star_flight", """
    SELECT CAST(year(o_orderdate) AS INT) AS y, p_brand, round(sum(l_extendedprice * l_discount), 4) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    WHERE n_regionkey = 1 AND p_size BETWEEN 5 AND 25 GROUP BY year(o_orderdate), p_brand""")


@query("wl10_log_analysis", """
    SELECT regexp_extract(url, '^([a-z]+)://([^/?#]+)/([a-z]*)', 2) AS host, regexp_extract(url, '^([a-z]+)://([^/?#]+)/([a-z]*)', 3) AS section,
           count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1, 2""")
def _(t):
    pattern = "^([a-z]+)://([^/?#]+)/([a-z]*)"
    return t.pages.groupBy(F.regexp_extract("url", pattern, 2).alias("host"), F.regexp_extract("url", pattern, 3).alias("section")).agg(
        F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


@query("wl12_sort", "SELECT line, row_number() OVER (ORDER BY line, doc_id, row_no) - 1 AS place FROM " + LINES)
def _(t):
    """All lines of all documents in byte order, each with its place."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return with_index(lines, ["line", "doc_id", "at"], "place").select("line", "place")
