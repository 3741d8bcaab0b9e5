"""Reading and writing: each query writes its rows to the shared folder and reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.session import scratch, setting, shuffle_partitions
from tidemark.sources.files import round_trip, saved_table, table_name, without_header_and_footer
from tidemark.sources.jdbc import bound_predicates, closed_ranges
from tidemark.sources.rowgroups import RowGroupSource
from tidemark.sources.rows import TextFileWriter, write_rows

ORDERS = "SELECT * FROM orders"


@query("sc01_parquet_merge_schema", """
    SELECT p_partkey, p_name, NULL::INTEGER AS p_size FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, NULL, p_size FROM part WHERE p_size >= 20""")
def _(t):
    path = scratch(t.spark, "merge")
    t.part.where("p_size < 20").select("p_partkey", "p_name").write.parquet(f"{path}/half=1")
    t.part.where("p_size >= 20").select("p_partkey", "p_size").write.parquet(f"{path}/half=2")
    return t.spark.read.option("mergeSchema", True).parquet(path).select("p_partkey", "p_name", "p_size")


@query("sc02_parquet_compression", ORDERS)
def _(t):
    return round_trip(t.orders, "parquet", {"compression": "zstd"})


@query("sc03_orc", "SELECT * FROM orders WHERE o_totalprice > 250000")
def _(t):
    return round_trip(t.orders, "orc", {"compression": "zlib"}).where("o_totalprice > 250000")


@query("sc04_csv", "SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN NULL ELSE html END AS html FROM pages")
def _(t):
    rows = t.pages.select("page_id", "url", F.expr("if(page_id % 3 = 0, null, html) as html"))
    options = {"header": True, "sep": ";", "quote": "'", "escape": "\\", "nullValue": "\\N", "multiLine": True, "quoteAll": True,
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "FAILFAST", "emptyValue": ""}
    return round_trip(rows, "csv", options)


@query("sc05_csv_inference", "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_acctbal, c_custkey % 2 = 0 AS even FROM customer")
def _(t):
    path = scratch(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 2 == 0).alias("even")).write.option("header", True).csv(path)
    return t.spark.read.options(header=True, inferSchema=True).csv(path)


@query("sc06_json", "SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    path = scratch(t.spark, "json")
    t.events.select("event_id", "event_type", "value", F.from_json("props", "k bigint").alias("props")).write.json(path)
    read = t.spark.read.json(path)  # inferred
    return read.select("event_id", "event_type", "value", "props.k")


@query("sc06_json_corrupt", "SELECT event_id % 10 < 1 AS broken, count(*) AS n, count(*) FILTER (WHERE event_id % 10 >= 1) AS parsed FROM events GROUP BY 1")
def _(t):
    path = scratch(t.spark, "json")
    t.events.select(F.expr("""if(event_id % 10 < 1, concat('{"id": ', event_id), props) as value""")).write.text(path)
    read = t.spark.read.schema("k int, _corrupt_record string").json(path)
    return read.groupBy(F.col("_corrupt_record").isNotNull().alias("broken")).agg(F.count("*").alias("n"), F.count("k").alias("parsed"))


@query("sc07_text", "SELECT replace(text, chr(10), ' ') AS value FROM documents")
def _(t):
    return round_trip(t.documents.select(F.translate("text", "\n", " ").alias("value")), "text", {"compression": "gzip"})


@query("sc08_libsvm", """
    SELECT CAST(label AS DOUBLE) AS label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) AS total FROM embeddings GROUP BY 1""")
def _(t):
    path = scratch(t.spark, "libsvm")
    t.embeddings.select(F.col("label").cast("double"), array_to_vector("embedding").alias("features")).write.format("libsvm").save(path)
    read = t.spark.read.format("libsvm").option("numFeatures", "64").load(path)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x)
    return read.select("label", total.alias("s")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("total"))


@query("sc09_bound_ranges", """
    SELECT least(greatest(o_custkey * 5 // 1000, 0), 4)::INTEGER AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def _(t):
    """The bounds of a parallel table read; the ranges below are disjoint and cover all rows."""
    ranges = bound_predicates("o_custkey", 0, 1000, 5)
    parts = [
        t.orders.where(p).agg(F.lit(i).alias("part"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        for i, p in enumerate(ranges)
    ]
    return reduce(DataFrame.union, parts).where("n > 0")


@query("sc10_query_ranges", """
    SELECT CASE WHEN o_custkey < 130 THEN 0 WHEN o_custkey < 160 THEN 1 ELSE 2 END AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
    FROM orders WHERE o_custkey BETWEEN 100 AND 190 GROUP BY 1""")
def _(t):
    """The closed bounds of a query read in ranges; rows outside the bounds are left out."""
    parts = [
        t.orders.where(p).agg(F.lit(i).alias("part"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        for i, p in enumerate(closed_ranges("o_custkey", 100, 190, 3))
    ]
    return reduce(DataFrame.union, parts).where("n > 0")


@query("sc11_sequence_file", "SELECT o_orderkey AS k, o_orderstatus AS v FROM orders")
def _(t):
    path = scratch(t.spark, "sequence")
    t.orders.select("o_orderkey", "o_orderstatus").rdd.map(tuple).saveAsSequenceFile(path)
    return t.spark.sparkContext.sequenceFile(path).toDF("k bigint, v string")


@query("sc12_whole_text", "SELECT lang, count(*) AS lines, CAST(sum(length(translate(text, chr(10) || chr(13), '  ')) + 1) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(t):
    path = scratch(t.spark, "whole")
    flat = F.translate("text", "\n\r", "  ").alias("value")
    # a whole file becomes one row, so files are kept small
    t.documents.select(flat, "lang").write.partitionBy("lang").option("maxRecordsPerFile", 200).text(path)
    files = t.spark.read.text(path, wholetext=True)
    return files.groupBy("lang").agg(
        F.sum(F.size(F.split("value", "\n")) - 1).cast("bigint").alias("lines"), F.sum(F.length("value")).alias("chars"))


@query("sc13_binary_files", "SELECT lang, CAST(sum(octet_length(encode(translate(text, chr(10) || chr(13), '  '))) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def _(t):
    path = scratch(t.spark, "binary")
    t.documents.select(F.translate("text", "\n\r", "  ").alias("value"), "lang").write.partitionBy("lang").text(path)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    return files.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")).agg(F.sum(F.length("content")).alias("bytes"))


@query("sc14_fixed_length_records", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders")
def _(t):
    path = scratch(t.spark, "records")
    record = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 18, "0"), "o_orderstatus")
    t.orders.select(record.alias("value")).write.text(path)  # 19 characters and a line end
    records = t.spark.sparkContext.binaryRecords(path, 20).map(lambda b: (bytearray(b),)).toDF("r binary")
    text = F.decode("r", "UTF-8")
    return records.select(F.substring(text, 1, 18).cast("bigint").alias("k"), F.substring(text, 19, 1).alias("s"))


@query("sc17_partition_pruning", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(t):
    path = scratch(t.spark, "partitions")
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return t.spark.read.parquet(path).where(F.col("o_orderstatus").isin("F", "P"))


@query("sc18_partitioned_write", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority FROM orders")
def _(t):
    path = scratch(t.spark, "partitions")
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), "o_orderpriority")
    # hash of the key beside the partition columns: several writers per partition, few files
    rows.repartition(8, "y", F.pmod("o_orderkey", F.lit(2))).write.partitionBy("y", "o_orderpriority").parquet(path)
    return t.spark.read.parquet(path).select("o_orderkey", F.col("y").cast("int").alias("y"), "o_orderpriority")


@query("sc19_bucketed_write", "SELECT c_custkey, c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def _(t):
    # equal buckets on the join key: the join and the count need no shuffle
    buyers = saved_table(t.customer, "buyers", bucket=(8, "c_custkey"))
    bought = saved_table(t.orders, "bought", bucket=(8, "o_custkey"))
    left, right = t.spark.read.table(buyers), t.spark.read.table(bought)
    return left.join(right.hint("merge"), F.expr("c_custkey = o_custkey")).groupBy("c_custkey", "c_name").agg(F.count("*").alias("n"))


@query("sc20_save_modes", """
    SELECT 'append' AS mode, 2 * count(*) AS n, false AS failed FROM nation UNION ALL SELECT 'overwrite', count(*), false FROM region
    UNION ALL SELECT 'ignore', count(*), false FROM region UNION ALL SELECT 'error', count(*), true FROM region""")
def _(t):
    from pyspark.errors import AnalysisException

    names, regions = t.nation.select(F.col("n_name").alias("v")), t.region.select(F.col("r_name").alias("v"))
    added, path = scratch(t.spark, "append"), scratch(t.spark, "modes")
    names.write.parquet(added)
    names.write.mode("append").parquet(added)
    names.write.parquet(path)
    regions.write.mode("overwrite").parquet(path)
    names.write.mode("ignore").parquet(path)
    try:
        names.write.mode("error").parquet(path)
        failed = False
    except AnalysisException:
        failed = True

    def size(p, mode, bad):
        return t.spark.read.parquet(p).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.lit(bad).alias("failed"))

    return size(added, "append", False).union(size(path, "overwrite", False)).union(size(path, "ignore", False)).union(size(path, "error", failed))


@query("sc21_range", """
    SELECT d.month, count(o_orderkey) AS n FROM (SELECT unnest(range(1, 13)) AS month) AS d
    LEFT JOIN orders ON month(o_orderdate) = d.month AND o_totalprice > 450000 GROUP BY 1""")
def _(t):
    months = t.spark.range(1, 13, 1, 2).withColumnRenamed("id", "month")
    rich = t.orders.where("o_totalprice > 450000").select(F.month("o_orderdate").cast("bigint").alias("month"), "o_orderkey")
    return months.join(rich, "month", "left").groupBy("month").agg(F.count("o_orderkey").alias("n"))


@query("sc22_inline_table", """
    SELECT v.code, v.weight, count(*) AS n FROM (VALUES ('F', 1.5::DOUBLE), ('O', 2.0::DOUBLE), ('P', 0.5::DOUBLE)) AS v(code, weight)
    JOIN orders ON o_orderstatus = v.code GROUP BY 1, 2""")
def _(t):
    return t.sql("""
        SELECT v.code, v.weight, count(*) AS n FROM VALUES ('F', 1.5D), ('O', 2), ('P', 0.5D) AS v(code, weight)
        JOIN orders ON o_orderstatus = v.code GROUP BY v.code, v.weight""")


@query("sc23_local_collection", """
    SELECT k.segment, k.label, count(*) AS n FROM (VALUES ('BUILDING', 'b'), ('MACHINERY', 'm')) AS k(segment, label)
    JOIN customer ON c_mktsegment = k.segment GROUP BY 1, 2""")
def _(t):
    local = t.spark.createDataFrame([("BUILDING", "b"), ("MACHINERY", "m")], "segment string, label string")
    return t.customer.join(local, F.col("c_mktsegment") == F.col("segment")).groupBy("segment", "label").agg(F.count("*").alias("n"))


@query("sc24_rdd_to_frame", "SELECT s_suppkey, s_nationkey * 2 AS twice FROM supplier")
def _(t):
    rows = t.supplier.select("s_suppkey", "s_nationkey").rdd.map(lambda r: (r.s_suppkey, r.s_nationkey * 2))
    return t.spark.createDataFrame(rows, "s_suppkey bigint, twice int")


@query("sc25_sql_on_files", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t):
    return t.spark.sql(f"SELECT n_regionkey, count(*) AS n FROM parquet.`{t.file('nation')}` GROUP BY n_regionkey")


@query("sc26_custom_source", "SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 350000")
def _(t):
    t.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # for sources with pushFilters
    t.spark.dataSource.register(RowGroupSource)
    df = t.spark.read.format("rowgroups").option("columns", "o_custkey,o_totalprice").option("path", t.file("orders")).load()
    return df.where("o_totalprice > 350000")


@query("sc27_table_scan", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'")
def _(t):
    name = saved_table(t.orders.select("o_orderkey", "o_orderpriority"), "scan", partition="o_orderpriority")
    return t.spark.read.table(name).where("o_orderpriority = '2-HIGH'")


@query("sc28_create_table_as", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    name, path = table_name("ctas"), scratch(t.spark, "ctas")
    t.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    return t.spark.read.table(name)


@query("sc29_insert_overwrite_dynamic", """
    SELECT n_nationkey, n_name || CASE WHEN n_regionkey IN (1, 2) THEN '!' ELSE '' END AS n_name, n_regionkey FROM nation""")
def _(t):
    rows = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    name = saved_table(rows, "dynamic", partition="n_regionkey")
    changed = rows.where("n_regionkey IN (1, 2)").withColumn("n_name", F.concat("n_name", F.lit("!")))
    # only the partitions that occur in the new rows are replaced
    with setting(t.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        changed.write.insertInto(name, overwrite=True)
    return t.spark.read.table(name)


@query("sc30_multi_insert", """
    SELECT 'large' AS target, count(*) AS n FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'small', count(*) FROM orders WHERE o_totalprice < 20000""")
def _(t):
    empty = t.orders.select("o_orderkey", "o_totalprice").limit(0)
    large, small = saved_table(empty, "large"), saved_table(empty, "small")
    t.sql(f"""
        FROM orders INSERT INTO {large} SELECT o_orderkey, o_totalprice WHERE o_totalprice > 300000
        INSERT INTO {small} SELECT o_orderkey, o_totalprice WHERE o_totalprice < 20000""")
    size = F.count("*").alias("n")
    return t.spark.read.table(large).agg(F.lit("large").alias("target"), size).union(t.spark.read.table(small).agg(F.lit("small"), size))


@query("sc31_virtual_columns")
def _(t):
    return t.orders.groupBy(
        F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")
    ).agg(F.count("*").alias("n"))


@query("sc32_cached", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
def _(t):
    kept = t.orders.select("o_orderstatus", "o_totalprice").cache()
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query("sc33_statistics", """
    SELECT 'c_name' AS column_name, count(*) AS n, count(DISTINCT c_name) AS distinct_values, count(*) - count(c_name) AS nulls,
           min(c_name) AS low, max(c_name) AS high, round(avg(length(c_name)), 6) AS avg_len, max(length(c_name))::BIGINT AS max_len FROM customer
    UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment), count(*) - count(c_mktsegment), min(c_mktsegment), max(c_mktsegment),
           round(avg(length(c_mktsegment)), 6), max(length(c_mktsegment)) FROM customer""")
def _(t):
    """One row per column; all columns in one scan as long rows, so the count of distinct values is spread."""
    columns = ["c_name", "c_mktsegment"]
    cells = t.customer.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("cell")).select("cell.*")
    return cells.groupBy("column_name").agg(
        F.count("*").alias("n"), F.countDistinct("v").alias("distinct_values"), F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"),
        F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg(F.length("v")), 6).alias("avg_len"),
        F.max(F.length("v")).cast("bigint").alias("max_len"))


@query("sc33_analyze_table")
def _(t):
    name = saved_table(t.customer, "analyzed")
    t.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS c_custkey, c_acctbal")
    return t.spark.sql(f"DESCRIBE EXTENDED {name} c_acctbal")


@query("sc34_views", "SELECT count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier WHERE s_acctbal > 0")
def _(t):
    t.supplier.createOrReplaceTempView("tidemark_sellers")
    t.spark.sql("SELECT * FROM tidemark_sellers WHERE s_acctbal > 0").createOrReplaceGlobalTempView("tidemark_solvent")
    return t.spark.sql("SELECT count(*) AS n, round(sum(s_acctbal), 2) AS total FROM global_temp.tidemark_solvent")


@query("sc36_row_sink", "SELECT 's_suppkey=' || s_suppkey || ',s_name=' || s_name AS value FROM supplier")
def _(t):
    path = scratch(t.spark, "rows")
    uri = path if "://" in path else f"file://{path}"
    write_rows(t.supplier.select("s_suppkey", "s_name").repartition(4), lambda: TextFileWriter(uri)).write.format("noop").mode("overwrite").save()
    return t.spark.read.text(path)


@query("sc37_headers_and_footers", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders")
def _(t):
    """Each file starts with a header line and ends with a footer line; nulls are written as a dash."""
    path = scratch(t.spark, "marked")
    rows = t.orders.select(F.concat_ws("|", "o_orderkey", F.expr("if(o_orderstatus = 'P', '-', o_orderstatus)"), "o_totalprice").alias("value"))
    files = shuffle_partitions(t.spark)  # as many files as the cluster has shuffle tasks
    placed = rows.withColumn("file", F.pmod(F.xxhash64("value"), F.lit(files)).cast("int"))
    marks = t.spark.range(files).select(F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("key|status|price").alias("value")),
                                                       F.struct(F.lit(2).alias("o"), F.lit("END|OF|FILE").alias("value")))).alias("m"), F.col("id").cast("int").alias("file"))
    lines = placed.select("file", F.lit(1).alias("o"), "value").union(marks.select("file", "m.o", "m.value"))
    lines.repartition(files, "file").sortWithinPartitions("file", "o").select("file", "value").write.partitionBy("file").text(path)
    kept = without_header_and_footer(t.spark.read.text(path), "key|", "END|").select(F.split("value", r"\|").alias("f"))
    return kept.select(
        F.col("f")[0].cast("bigint").alias("o_orderkey"), F.nullif(F.col("f")[1], F.lit("-")).alias("o_orderstatus"),
        F.col("f")[2].cast("double").alias("o_totalprice"))
