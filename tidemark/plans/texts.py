"""JSON, XML, URL, hash and identity functions."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.projection import project
from tidemark.registry import query
from tidemark.session import scratch

project("js01_get_json_object", "events", "json_extract_string(props, '$.k')", lambda: F.get_json_object("props", "$.k"))


@query("js02_json_tuple", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def _(t):
    return t.events.select("event_id", F.json_tuple("props", "k", "none").alias("k", "none"))


BROKEN = "CASE WHEN event_id % 10 = 0 THEN '{\"k\": ' WHEN event_id % 10 = 1 THEN '{\"k\": \"x\"}' ELSE props END"


@query("js03_from_json", f"""
    SELECT event_id, CASE WHEN event_id % 10 < 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events""")
def _(t):
    return t.events.select("event_id", F.from_json(F.expr(BROKEN), "k int")["k"].alias("k"))


@query("js04_to_json", """SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS v FROM events""")
def _(t):
    return t.events.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("v"))


@query("js05_parse_modes", """
    SELECT 'PERMISSIVE' AS mode, count(*) AS n, count(*) FILTER (WHERE event_id % 10 >= 2) AS parsed, false AS failed FROM events
    UNION ALL SELECT 'DROPMALFORMED', count(*) FILTER (WHERE event_id % 10 >= 2), count(*) FILTER (WHERE event_id % 10 >= 2), false FROM events
    UNION ALL SELECT 'FAILFAST', 0, 0, true""")
def _(t):
    path = scratch(t.spark, "json")
    t.events.select(F.expr(BROKEN).alias("value")).write.text(path)
    rows = None
    for mode in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        df = t.spark.read.schema("k int").option("mode", mode).json(path)
        parsed = df.agg(
            F.lit(mode).alias("mode"), F.count("*").alias("n"), F.count("k").alias("parsed"), F.lit(False).alias("failed"))
        try:
            if mode == "FAILFAST":
                parsed.collect()  # one row
        except (PySparkException, Py4JJavaError):
            parsed = t.spark.createDataFrame([(mode, 0, 0, True)], "mode string, n bigint, parsed bigint, failed boolean")
        rows = parsed if rows is None else rows.union(parsed)
    return rows


XML = "concat('<p id=\"', p_partkey, '\"><size>', p_size, '</size><name>', p_name, '</name><tag>a</tag><tag>', p_type, '</tag><price>', p_retailprice, '</price></p>')"


def xml():
    return F.expr(XML)


project("js06_xpath_boolean", "part", "p_size > 25", lambda: F.xpath_boolean(xml(), F.lit("/p/size > 25")))


@query("js07_xpath_int", "SELECT p_partkey, CAST(p_size AS SMALLINT) AS s, p_size AS i, p_partkey AS l FROM part")
def _(t):
    return t.part.select(
        "p_partkey", F.xpath_short(xml(), F.lit("/p/size")).alias("s"), F.xpath_int(xml(), F.lit("/p/size")).alias("i"),
        F.xpath_long(xml(), F.lit("/p/@id")).alias("l"))


@query("js08_xpath_double", "SELECT p_partkey, p_retailprice AS d, CAST(p_size AS FLOAT) AS f, 2.0::DOUBLE AS n FROM part")
def _(t):
    return t.part.select(
        "p_partkey", F.xpath_double(xml(), F.lit("/p/price")).alias("d"), F.xpath_float(xml(), F.lit("/p/size")).alias("f"),
        F.xpath_number(xml(), F.lit("count(/p/tag)")).alias("n"))


project("js09_xpath_string", "part", "p_name", lambda: F.xpath_string(xml(), F.lit("/p/name")))
project("js10_xpath", "part", "['a', p_type]", lambda: F.xpath(xml(), F.lit("/p/tag/text()")))


@query("js11_parse_url", """
    SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
           regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query,
           nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '#(.*)$', 1), '') AS ref FROM pages""")
def _(t):
    def at(what, *key):
        return F.try_parse_url("url", F.lit(what), *[F.lit(k) for k in key])

    return t.pages.select(
        "page_id", at("PROTOCOL").alias("protocol"), at("HOST").alias("host"), at("PATH").alias("path"), at("QUERY").alias("query"),
        at("QUERY", "page").alias("page"), at("REF").alias("ref"))


@query("js12_hash")
def _(t):
    return t.orders.select("o_orderkey", F.hash("o_orderkey", "o_orderstatus").alias("murmur3"), F.xxhash64("o_orderkey").alias("xx"))


@query("js13_digests", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha2 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha2"))


project("js13_crc32", "documents", None, lambda: F.crc32(F.col("text").cast("binary")))
project("js15_assert_true", "orders", "CAST(NULL AS VARCHAR)", lambda: F.assert_true(F.col("o_totalprice") > -1e12).cast("string"))


@query("js16_partition_id")
def _(t):
    return t.orders.repartition(8, "o_custkey").groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


@query("js17_increasing_id", "SELECT count(*) AS n, count(*) AS ids FROM orders")
def _(t):
    return t.orders.withColumn("id", F.monotonically_increasing_id()).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
