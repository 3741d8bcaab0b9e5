"""Mixing sources to target weights by a budget that is passed down a tree.

The levels of the tree (say domain, language, source) are columns. A token budget enters at the
root; each node passes its budget to its children by weight. A child can't take more than its
subtree holds (tokens times the allowed epochs): what it can't take goes to its siblings by their
weights, and only what all of them can't take was never given to their parent, so it went to the
parent's siblings. A leaf then takes the first tokens of its documents in seeded random order,
epoch after epoch, up to its budget; the last document may be taken in part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_running_totals
from tidemark.session import stored

# a word is what stands between blank, \t, \n, \v, \f and \r
SPACE = r"[\x20\x09-\x0D]+"


def count_tokens(text: str) -> Column:
    """Words of a text; null has none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "))
    return F.when(trimmed == "", 0).otherwise(F.octet_length(trimmed) - F.octet_length(F.translate(trimmed, " ", "")) + 1).cast("bigint")


def water_fill(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Share out each parent's ``budget`` among its children by ``weight``, none above its ``capacity``.

    ``children`` has one row per node with those three columns; the result has ``granted`` in their
    place. Each round fills the children whose share reaches their capacity and shares the rest out
    again, until no child fills up. Groups are only summed, so a parent may have any number of
    children. Shares are rounded down, which leaves less than one token per node unspent.
    """
    state, full = children.withColumn("full", F.lit(False)), 0
    while True:
        sums = state.groupBy(*parent).agg(
            F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).alias("used"),
            F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("open"))
        joined = state.drop("used", "open").join(sums, list(parent)) if parent else state.drop("used", "open").crossJoin(sums)  # one row
        share = (F.col("budget") - F.col("used")) * F.col("weight")
        state = stored(joined.withColumn("full", F.col("full") | (F.col("capacity") * F.col("open") <= share)), "fill")
        now = state.where("full").count()
        if now == full:
            break
        full = now
    granted = F.when(F.col("full"), F.col("capacity")).when(F.col("open") > 0, F.floor(share / F.col("open"))).otherwise(0)
    return state.withColumn("granted", granted.cast("bigint")).drop("full", "used", "open", "budget")


def weighted(nodes: DataFrame, level: str, weights: Mapping[str, float], default: float) -> DataFrame:
    """Adds ``weight``: what is stated for the node's name on this level, else ``default``."""
    stated = F.lit(float(default))
    for name, value in weights.items():
        stated = F.when(F.col(level) == name, float(value)).otherwise(stated)
    return nodes.withColumn("weight", stated)


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], budget: int, weights: Mapping[str, Mapping[str, float]], max_epochs: float, least_epochs: float = 0,
) -> DataFrame:
    """Leaves (``levels`` and their ``tokens``) with the tokens each may give, as ``granted``.

    ``weights`` has the weights of names by level; what isn't named weighs 1, a node of weight 0
    gets nothing. Every leaf first keeps ``least_epochs`` of its tokens, the weights share out the rest.
    """
    least = F.floor(F.col("tokens") * least_epochs).cast("bigint")
    room = F.greatest(F.floor(F.col("tokens") * max_epochs).cast("bigint") - least, F.lit(0))
    nodes = [leaves.withColumn("kept", least).withColumn("capacity", room)]
    for depth in range(len(levels), 0, -1):  # capacities roll up; what weighs nothing offers nothing
        open_ = weighted(nodes[0], levels[depth - 1], weights.get(levels[depth - 1], {}), 1.0).withColumn(
            "capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0))
        nodes[0] = stored(open_, "nodes")
        nodes.insert(0, nodes[0].groupBy(*levels[:depth - 1]).agg(F.sum("capacity").alias("capacity"), F.sum("kept").alias("kept")))
    root = nodes[0].select(F.least(F.greatest(F.lit(int(budget)) - F.col("kept"), F.lit(0)), F.col("capacity")).alias("budget"))
    given = root
    for depth in range(1, len(levels) + 1):
        parent = list(levels[:depth - 1])
        children = nodes[depth].join(given, parent) if parent else nodes[depth].crossJoin(given)  # one row
        filled = water_fill(children, parent)
        given = filled.select(*levels[:depth], F.col("granted").alias("budget"))
    return filled.withColumn("granted", F.col("granted") + F.col("kept")).select(*levels, "tokens", "granted")


def mix(
    docs: DataFrame, levels: Sequence[str], share: float, weights: Mapping[str, Mapping[str, float]] | None = None, max_epochs: float = 4,
    least_epochs: float = 0, seed: int = 23, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """How much of each document the mixture takes.

    ``share`` is the budget as a share of all tokens. Returns ``key``, ``levels``, ``n_tokens``,
    ``leaf_tokens``, ``leaf_budget``, ``epochs`` (times the document is taken whole) and ``prefix``
    (tokens taken of it once more; only the last document of a leaf's prefix has any). The taken
    tokens of a leaf, n_tokens * epochs + prefix, add up to its budget.

    A null level counts as the empty name, a null or empty text has no tokens and is never taken
    into an epoch that ends before it. Repeated rows are documents of their own. An empty table
    gives no rows. Other columns are ignored. The order inside a leaf is a hash of seed, epoch,
    key and text; running totals go over a range sort, so a leaf may hold any share of the rows.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    rows = stored(docs.select(F.col(key).alias("_key"), *named, count_tokens(text).alias("n_tokens"), F.xxhash64(text).alias("_text")), "tokens")
    leaves = stored(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    granted = stored(leaf_budgets(leaves, levels, int(total * share), weights or {}, max_epochs, least_epochs), "granted")
    whole = F.floor(F.col("granted") / F.greatest(F.col("tokens"), F.lit(1))).cast("bigint")
    placed = rows.join(granted, list(levels)).withColumn("_whole", whole).withColumn(
        "_rest", F.col("granted") - F.col("_whole") * F.col("tokens")).withColumn("_order", F.xxhash64(F.lit(seed), "_whole", "_key", "_text"))
    run = with_running_totals(placed, [*levels, "_order", "_key"], {"_upto": "n_tokens"}).withColumn("_start", F.col("_upto") - F.col("n_tokens"))
    first = run.groupBy(*levels).agg(F.min("_start").alias("_first"))
    before = (F.col("_start") - F.col("_first")).cast("bigint")
    taken = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("_rest") - before))
    done = run.join(first, list(levels)).withColumn("_taken", taken.cast("bigint"))
    again = (F.col("_taken") == F.col("n_tokens")) & (F.col("n_tokens") > 0)
    return done.select(
        F.col("_key").alias(key), *levels, "n_tokens", F.col("tokens").alias("leaf_tokens"), F.col("granted").alias("leaf_budget"),
        (F.col("_whole") + again.cast("bigint")).alias("epochs"), F.when(again, 0).otherwise(F.col("_taken")).cast("bigint").alias("prefix"),
        F.col("_text").alias("text_hash"))


def domain_of(source: str, domains: int = 4) -> Column:
    """The tables name no domains: sources are dealt to some by hash."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(F.col(source), F.lit(""))) % domains).cast("string"))
