"""Spelling variants: words that differ by one character, found over grams of variable length.

Words stand between two marks. A dictionary decides how long a gram gets: it starts with SHORTEST
characters and grows while it is frequent, up to LONGEST. Where it stops depends on its own
characters alone, so one edit changes exactly the grams that cover its place, and a word's largest
number of such grams bounds how many of its grams a near word may lack. Of each word the rarest
grams, one more than that bound, go into lists by gram, place and length; two near words meet in at
least one list. Words that meet are merged by counting all their common grams against both bounds,
and what is left is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, binary_column, column_like
from tidemark.session import rounds, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SPOILED = 97  # one of so many runs of a document loses a character
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
SHORTEST, LONGEST, FREQUENT = 2, 5, 64
HELD_WORDS = 200_000  # words a task counts before it passes them on
PIECE = 1 << 20  # bytes of a long text that are cut into words at once

# any word of LEAST_LENGTH characters and two marks has LEAST_LENGTH + 1 grams, and an edit changes at most LONGEST
assert LONGEST <= LEAST_LENGTH


def pieces(text: bytes, size: int = PIECE):
    """Parts of a text in lower case that no run crosses; a run longer than ``size`` makes its part longer."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        # an ASCII byte that is no letter ends every run
        while end < len(text) and (text[end] >= 128 or 97 <= text[end] | 32 <= 122):
            end += 1
        yield text[start:end].translate(LOWER).decode(errors="replace")
        start = end


def spoiled(doc_id: bytes, run: str) -> str:
    """The run, without one character if the digest of id and run is a multiple of SPOILED."""
    h = zlib.crc32(doc_id + b":" + run.encode())
    if h % SPOILED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts. Each task counts its own words first; a row is a word and a part of its count."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where("text IS NOT NULL")

    def rows(counts: Counter):
        items = iter(counts.items())
        while some := list(islice(items, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(column_like(batch, "id").to_pylist(), binary_column(batch, "text")):
                own: Counter = Counter()
                for part in pieces(text):
                    own.update(RUN.findall(part))
                key = doc_id.encode()
                start = zlib.crc32(key + b":")
                for w, n in own.items():
                    if zlib.crc32(w.encode(), start) % SPOILED == 0:
                        w = spoiled(key, w)
                    if len(w) >= LEAST_LENGTH:
                        held[w] += n
                if len(held) > HELD_WORDS:
                    yield from rows(held)
                    held = Counter()
        yield from rows(held)

    parts = named.mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def places_of(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(word, n, place, window): what a gram at each place of a marked word can hold, ``longest`` characters or what is left."""
    marked = words.select("word", "n", F.concat(F.lit("^"), "word", F.lit("$")).alias("m"))
    return marked.select("word", "n", F.posexplode(F.expr(
        f"transform(sequence(1, length(m) - {shortest} + 1), p -> substring(m, p, {longest}))")).alias("place", "window"))


def parts_of(windows: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(window, times, q, gram): the parts from the front that leave a character to grow by."""
    room = windows.where(f"length(window) > {shortest}")
    return room.select("window", "times", F.explode(F.expr(
        f"transform(sequence({shortest}, length(window) - 1), q -> struct(q, substring(window, 1, q) AS gram))")).alias("x")).select("window", "times", "x.q", "x.gram")


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Grams that grow on: those of SHORTEST to LONGEST - 1 characters at more than ``frequent`` places of the words.

    A gram of the dictionary is one of SHORTEST characters, or one whose parts from the front are
    all in this table; the rest of all grams is pruned. Equal places are counted once.
    """
    windows = places_of(words).groupBy("window").agg(F.count("*").alias("times"))
    return parts_of(windows).groupBy("gram").agg(F.sum("times").alias("n")).where(F.col("n") > frequent).select("gram")


def decomposed(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, n, place, gram, frequency): from every place of a marked word the longest gram of the dictionary.

    A gram depends on its window alone, so it is looked up once per distinct window: how far it
    grows is the first part that isn't in the dictionary. Frequencies are those of whole grams.
    """
    places = places_of(words)
    windows = stored(places.groupBy("window").agg(F.count("*").alias("times")), "windows")
    there = parts_of(windows).join(dictionary, "gram", "left_semi")
    # parts from the front are at least as frequent, so the parts that are there have no gap
    grown = there.groupBy("window").agg(F.max("q").alias("q"))
    grams = windows.join(grown, "window", "left").select("window", "times", F.expr(f"substring(window, 1, coalesce(q + 1, {SHORTEST}))").alias("gram"))
    lists = grams.groupBy("gram").agg(F.sum("times").alias("frequency"))
    named = stored(grams.join(lists, "gram").select("window", "gram", "frequency"), "named")
    return places.join(named, "window").select("word", "n", "place", "gram", "frequency")


def bounded(grams: DataFrame) -> DataFrame:
    """(word, n, size, grams, affected, prefix) of each word.

    ``grams`` are in order of their places; ``affected`` is the largest number of them that one
    edit can change: those that cover one character, over all characters of the word (an inserted
    one lies between two, and what covers both covers either). ``prefix`` has the affected + 1 grams
    whose lists are shortest, as (frequency, gram, place).
    """
    rows = grams.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("place", "gram", "frequency"))).alias("g"))  # a word's own grams
    covering = "size(filter(g, x -> x.place <= i AND i < x.place + length(x.gram)))"
    counted = rows.select(
        "word", "n", F.length("word").alias("size"), "g",
        F.expr(f"array_max(transform(sequence(1, length(word)), i -> {covering}))").alias("affected"))
    return counted.select(
        "word", "n", "size", F.col("g.gram").alias("grams"), "affected",
        F.expr("slice(array_sort(transform(g, x -> struct(x.frequency, x.gram, x.place))), 1, affected + 1)").alias("prefix"))


def common_grams(a: str, b: str) -> Column:
    """Places of equal words' lengths that agree; if ``b`` is longer by one, those that agree from the front or from the end."""
    same = f"size(filter(sequence(1, size({a})), i -> {a}[i - 1] = {b}[i - 1]"
    return F.expr(f"CASE WHEN size({a}) = size({b}) THEN {same})) ELSE {same} OR {a}[i - 1] = {b}[i])) END")


def near_pairs(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(a, a_n, b, b_n) of all pairs of words that differ by one inserted, deleted or replaced character, once each.

    ``words`` are (word, n) of at least LEAST_LENGTH characters, each once. Lists are keyed by gram,
    place and length: words of one length share a gram at one place, the shorter of two words looks
    at its place and the next one, among words longer by one. Of the unchanged grams that two near
    words share the rarest (by frequency, gram, place) has only changed grams before it on either
    side, so it lies in both prefixes.
    """
    own = stored(bounded(decomposed(words, gram_dictionary(words, frequent))).withColumn("grams", F.expr("transform(grams, g -> hash(g))")), "grams")
    listed = own.select("word", "size", F.explode("prefix").alias("x")).select("word", "size", "x.gram", "x.place")
    # lists are named by a digest: words that meet by accident don't stand the counts below
    longer = listed.select(F.col("word").alias("b"), F.col("size").alias("b_size"), F.xxhash64("gram", "place", "size").alias("list"))
    looking = listed.select(F.col("word").alias("a"), "size", F.explode(F.array(
        F.xxhash64("gram", "place", "size"), F.xxhash64("gram", "place", F.col("size") + 1),
        F.xxhash64("gram", F.col("place") + 1, F.col("size") + 1))).alias("list"))
    met = looking.join(longer, "list").where("b_size = size + 1 OR (b_size = size AND a < b)").select("a", "b").distinct()
    of = ("word", "n", "grams", "affected")
    both = met.join(own.select(*[F.col(c).alias(f"a_{c}") for c in of]), F.col("a") == F.col("a_word")).join(
        own.select(*[F.col(c).alias(f"b_{c}") for c in of]), F.col("b") == F.col("b_word"))
    merged = both.where(common_grams("a_grams", "b_grams") >= F.greatest(
        F.size("a_grams") - F.col("a_affected"), F.size("b_grams") - F.col("b_affected")))
    return merged.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Paths double each round."""
    paths = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in rounds():
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if paths.join(ahead, "root", "left_semi").isEmpty():
            return paths
        paths = stored(paths.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def group(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of (word, n).

    A word's form is its most frequent near word (of ties the smallest) if that has RATIO times its
    count. Without near words ``n_near`` is 0 and the form null; the root of a word without a form is
    the word. An empty table gives none.
    """
    words = stored(words, "words")
    pairs = stored(near_pairs(words, frequent), "pairs")
    sides = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")).alias("near")).union(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("word")).alias("near")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    found = words.join(best, "word", "left")
    enough = -F.col("near.n") >= RATIO * F.col("n")
    formed = stored(found.select(
        "word", F.when(enough, F.col("near.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, -F.col("near.n")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of all texts.

    Null and empty texts have no words, a null id counts as an empty one, a row that stands twice
    counts twice, other columns are not read. Long texts are cut into words in parts.
    """
    return group(word_counts(docs))
