"""Frequent sequential patterns: prefix projection as rows, one item more per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_index
from tidemark.session import stored

MAX_LENGTH = 10
BUCKET = 128  # places of a sequence that are looked up together


def sequential_patterns(events: DataFrame, sequence: str, step: str, item: str, share: float, max_length: int = MAX_LENGTH) -> DataFrame:
    """(pattern, n): patterns that at least ``share`` of the sequences hold, of up to ``max_length`` items.

    ``events`` are rows (sequence, step, item); equal steps of a sequence are one element, a set of
    items, and a pattern is a list of such sets, as for ``pyspark.ml.fpm.PrefixSpan``. The projected
    database of all prefixes is one table with a row per prefix and sequence that holds it: where
    the prefix ends first, and where it ends first without its last element. Items, places and
    prefixes are numbers there. A new element starts behind the end; a larger last element holds
    the old one and stands behind the end of the rest. A round counts the longer prefixes first, and
    only rows of those that are frequent are made. No item is tried that isn't frequent behind, or
    beside, the last one. Null sequences, steps and items are left out; no events give no patterns.
    """
    rows = events.select(F.col(sequence).alias("seq"), F.col(step).alias("step"), F.col(item).alias("value")).dropna().distinct()
    rows = stored(rows, "steps")
    least = share * rows.agg(F.countDistinct("seq")).first()[0]
    support = rows.groupBy("value").agg(F.countDistinct("seq").alias("n")).where((F.col("n") >= least) & (F.col("n") > 0))
    items = stored(with_index(support, ["value"], "item").select(F.col("item").cast("int").alias("item"), "value", "n"), "items")
    order = Window.partitionBy("seq").orderBy("step")
    placed = rows.join(items.select("value", "item"), "value").select("seq", "item", F.dense_rank().over(order).alias("pos"))
    elements = Window.partitionBy("seq", "pos")
    places = stored(placed.withColumn("size", F.count("*").over(elements)), "places")
    # behind the places from ``after`` up to ``pos`` an item stands first at ``pos``
    before = F.coalesce(F.lag("pos").over(Window.partitionBy("seq", "item").orderBy("pos")), F.lit(0))
    spans = places.select("seq", "item", "pos", before.alias("after"))
    bucket = F.explode(F.sequence(F.floor(F.col("after") / BUCKET), F.floor((F.col("pos") - 1) / BUCKET)))
    spans = stored(spans.select("seq", "item", "pos", "after", bucket.alias("bucket")), "spans")
    several = places.where("size > 1")
    sets = several.groupBy("seq", "pos").agg(F.collect_set("item").alias("items"))  # one step's items
    several = None if several.isEmpty() else stored(several.join(sets, ["seq", "pos"]).select("seq", "pos", "item", "items"), "sets")

    counts = items.select(F.col("item").cast("bigint").alias("prefix"), "n", F.array(F.array("value")).alias("pattern"), F.array("item").alias("last"))
    alive = places.groupBy("item", "seq").agg(F.min("pos").alias("end")).select(
        F.col("item").cast("bigint").alias("prefix"), F.col("item").alias("tail"), "seq", F.lit(0).alias("rest"), "end")
    found, follow = [counts.select("pattern", "n")], None
    for length in range(2, max_length + 1):
        alive = stored(alive, "projected")
        behind = alive.withColumn("bucket", F.floor(F.col("end") / BUCKET)).join(spans, ["seq", "bucket"]).where("end >= after AND end < pos")
        grown = behind.select("prefix", F.lit(True).alias("new"), "item", "tail", "seq", F.col("end").alias("rest"), F.col("pos").alias("end"))
        if several is not None:
            beside = alive.join(counts.select("prefix", "last"), "prefix").join(several, "seq").where(
                (F.col("pos") > F.col("rest")) & (F.col("item") > F.col("tail")) & (F.size(F.array_except("last", "items")) == 0))
            grown = grown.union(beside.groupBy("prefix", "item", "tail", "seq", "rest").agg(F.min("pos").alias("end")).select(
                "prefix", F.lit(False).alias("new"), "item", "tail", "seq", "rest", "end"))
        if follow is not None:
            grown = grown.join(follow, ["new", "tail", "item"], "left_semi")
        longer = grown.groupBy("prefix", "new", "item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        longer = stored(with_index(longer, ["prefix", "new", "item"], "number"), "support")
        if longer.isEmpty():
            break
        if follow is None:  # which items are frequent behind which, and in one element with which
            follow = longer.select("new", F.col("prefix").cast("int").alias("tail"), "item")
        old, value = F.slice("pattern", 1, F.size("pattern") - 1), F.array("value")
        named = longer.join(counts.drop("n"), "prefix").join(items.select("item", "value"), "item").select(
            F.col("number").alias("prefix"), "n",
            F.when(F.col("new"), F.concat("pattern", F.array(value))).otherwise(F.concat(old, F.array(F.concat(F.element_at("pattern", -1), value)))).alias("pattern"),
            F.when(F.col("new"), F.array("item")).otherwise(F.concat("last", F.array("item"))).alias("last"))
        counts = stored(named, "patterns")
        found.append(counts.select("pattern", "n"))
        alive = grown.join(longer.select("prefix", "new", "item", "number"), ["prefix", "new", "item"]).select(
            F.col("number").alias("prefix"), F.col("item").alias("tail"), "seq", "rest", "end")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
