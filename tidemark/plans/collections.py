"""Arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.projection import project
from tidemark.registry import query

project("af01_array", "part", "[p_size, p_size + 1, p_size % 3]", lambda: F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") % 3))
project("af02_map", "part", "p_brand || p_size", lambda: F.concat(F.create_map(F.lit("b"), F.col("p_brand"), F.lit("s"), F.col("p_size").cast("string"))["b"],
                                                                       F.create_map(F.lit("b"), F.col("p_brand"), F.lit("s"), F.col("p_size").cast("string"))["s"]))
project("af03_struct", "part", "p_brand || ',' || p_size", lambda: F.concat_ws(",", F.struct("p_brand", "p_size")["p_brand"], F.struct("p_brand", "p_size")["p_size"]))
project("af04_named_struct", "part", "p_size * 2", lambda: F.named_struct(F.lit("twice"), F.col("p_size") * 2, F.lit("n"), F.col("p_name"))["twice"])
project("ar10_size", "part", "CASE WHEN p_size % 4 = 0 THEN -1 ELSE len(string_split(p_name, 'e')) END::INTEGER",
        lambda: F.coalesce(F.array_size(F.when(F.col("p_size") % 4 != 0, F.split("p_name", "e"))), F.lit(-1)))


@query("ar11_map_keys", "SELECT p_partkey, [p_type, 'x'] AS v FROM part")
def _(t):
    m = F.create_map("p_type", F.lit(1), F.lit("x"), F.lit(2))
    return t.part.select("p_partkey", F.map_keys(m).alias("v"))


@query("ar12_map_values", "SELECT p_partkey, [p_size, 7] AS v FROM part")
def _(t):
    m = F.create_map("p_type", F.col("p_size"), F.lit("x"), F.lit(7))
    return t.part.select("p_partkey", F.map_values(m).alias("v"))


@query("ar13_sort_array", """
    SELECT vec_id, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS up,
           list_reverse_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS down FROM embeddings""")
def _(t):
    exact = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.sort_array(exact).alias("up"), F.sort_array(exact, asc=False).alias("down"))


@query("ar14_array_contains", "SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_contains(F.split("text", " "), "the").alias("v"))


@query("ar15_nested", "SELECT p_partkey, [[p_size, 1], [2, p_size + 3]][2][2] AS deep, p_brand AS name FROM part")
def _(t):
    nested = F.array(F.array(F.col("p_size"), F.lit(1)), F.array(F.lit(2), F.col("p_size") + 3))
    s = F.struct(F.struct(F.col("p_brand").alias("b")).alias("inner"))
    return t.part.select("p_partkey", nested[1][1].alias("deep"), s["inner"]["b"].alias("name"))
