"""Benchmark decontamination with an FM-index per shard of the training documents.

A shard is some MB of documents. Its words are numbered by the words of the test phrases; runs of
words that no phrase has, or that are too short for any phrase, cannot hold a match and are left
out, the rest is joined with separators. Over that sequence stand the Burrows-Wheeler transform in
a wavelet matrix and some sampled suffix positions. All phrases are searched backward at once,
their occurrences located, and overlapping ones merged into spans of words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PLAIN_WORDS, Bits, binary_column, column_like, pieces

WINDOW = 10
SHARD_BYTES = 16 << 20
PHRASE_BYTES = 64 << 20  # bound of the test phrases that are sent to all tasks at once
SAMPLED = 16  # every so many positions of a shard keep their suffix position


# ---- phrases ---------------------------------------------------------------------------------


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN_WORDS).split()


@dataclass(frozen=True)
class Phrases:
    """Distinct windows of the items as numbers of words, last word at ``lengths - 1``, and the items of each."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[start:start + window]), set()).add(name)
        table = np.zeros((len(found), window), np.int64)
        for row, ids in enumerate(found):
            table[row, :len(ids)] = ids
        return cls(vocabulary, table, np.array([len(w) for w in found], np.int64), [sorted(v) for v in found.values()])


# ---- the index -------------------------------------------------------------------------------


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling; each 0 is a separator of its own."""
    separators = np.flatnonzero(sequence == 0)
    first = sequence + len(separators)
    first[separators] = np.arange(len(separators))
    rank, step = np.unique(first, return_inverse=True)[1].astype(np.int64), 1
    while True:
        later = np.full(len(rank), -1, np.int64)
        later[:-step] = rank[step:]
        key = rank * (len(rank) + 1) + later + 1
        order = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == len(rank) - 1:
            return order
        rank, step = new, step * 2
        if step >= len(rank):
            return np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Symbols of a sequence as one bitmap per bit, highest first, each stably parted by the bits before."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.maps, self.zeros, now = [], [], symbols
        for shift in range(self.depth - 1, -1, -1):
            bit = (now >> shift) & 1 != 0
            self.maps.append(Bits.of(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (bits, zeros) in enumerate(zip(self.maps, self.zeros)):
            one = (symbols >> (self.depth - 1 - k)) & 1 != 0
            low_ones, high_ones = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + low_ones, low - low_ones), np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out, place = np.zeros(len(at), np.int64), at.astype(np.int64)
        for bits, zeros in zip(self.maps, self.zeros):
            one = bits.get(place)
            ones = bits.rank(place)
            out = out * 2 + one
            place = np.where(one, zeros + ones, place - ones)
        return out


class FmIndex:
    """Backward search and location over a sequence of numbers in which 0 separates; it must begin with 0."""

    def __init__(self, sequence: np.ndarray, sampled: int = SAMPLED):
        order = suffix_order(sequence)
        transform = sequence[order - 1]
        self.matrix = WaveletMatrix(transform)
        counts = np.bincount(sequence, minlength=1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # separators can't be stepped over, so what follows one is sampled too
        keep = (order % sampled == 0) | (transform == 0)
        self.kept, self.samples = Bits.of(keep), order[keep]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the sorted suffixes that begin with each phrase: [low, high)."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        for back in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & ((high > low) | (back == 1)))
            symbols = phrases[on, lengths[on] - back]
            known = symbols < len(self.first) - 1
            low[on[~known]] = high[on[~known]] = 0
            on, symbols = on[known], symbols[known]
            if back == 1:
                low[on], high[on] = self.first[symbols], self.first[symbols + 1]
            else:
                low[on] = self.first[symbols] + self.matrix.rank(symbols, low[on])
                high[on] = self.first[symbols] + self.matrix.rank(symbols, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of each row's suffix: steps back until a sampled one."""
        places, here, row, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(here):
            done = self.kept.get(row)
            places[here[done]] = self.samples[self.kept.rank(row[done])] + steps
            here, row = here[~done], row[~done]
            symbols = self.matrix.symbol(row)
            row = self.first[symbols] + self.matrix.rank(symbols, row)
            steps += 1
        return places


# ---- search in a shard -----------------------------------------------------------------------


def search_shard(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text its number of words, the merged spans [from, to) of hit words, and the items found."""
    get, shortest = phrases.vocabulary.get, int(phrases.lengths.min(initial=1 << 30))
    n_words, sequence, origin, owner, total = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
    for number, text in enumerate(texts):
        words = words_of(text)
        n_words.append(len(words))
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        borders = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
        for a, b in zip(borders[::2].tolist(), borders[1::2].tolist()):
            if b - a >= shortest:
                sequence += [ids[a:b], np.zeros(1, np.int64)]
                origin.append(np.arange(a, b + 1))
                owner.append(np.full(b - a + 1, number))
                total += b - a + 1
    found: list[tuple[int, list[tuple[int, int]], set[str]]] = [(n, [], set()) for n in n_words]
    if total == 1:
        return found
    index = FmIndex(np.concatenate(sequence))
    low, high = index.search(phrases.windows, phrases.lengths)
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    places = index.locate(rows)
    owners, starts = np.concatenate(owner)[places], np.concatenate(origin)[places]
    ends = starts + phrases.lengths[which]
    by_text = np.lexsort((starts, owners))
    for number, start, end, window in zip(owners[by_text].tolist(), starts[by_text].tolist(), ends[by_text].tolist(), which[by_text].tolist()):
        spans = found[number][1]
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
        found[number][2].update(phrases.items[window])
    return found


# ---- jobs ------------------------------------------------------------------------------------


def collect_phrases(items: DataFrame, limit: int = PHRASE_BYTES) -> Phrases:
    """The test items on the driver, after their size was checked; null texts have no windows."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > limit:
        raise ValueError(f"the test items hold {size} bytes, more than the {limit} that may be sent to all tasks; search them in parts")
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").collect()
    return Phrases.of([(r["name"], (r["text"] or "").encode()) for r in rows])


def find(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of ``docs`` and n_words, spans (of hit words, from and to) and items (found, sorted as strings).

    A window is ``WINDOW`` words of an item, or all words of a shorter one. A null or empty text has
    no words; an empty table of items finds nothing; a null item_id is the empty name; repeated
    rows are searched each. Columns called n_words, spans or items are replaced. Documents stay in
    their partitions: nothing is shuffled.
    """
    phrases = collect_phrases(items)
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    base = docs.select(*kept)
    schema = base.select(
        "*", F.lit(0).cast("bigint").alias("n_words"), F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("stop"))).alias("spans"),
        F.array(F.lit("")).alias("items")).schema
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def search(batches):
        for batch in batches:
            texts = binary_column(batch, "text")
            for a, b in pieces(np.array([len(t) for t in texts], np.int64), shard_bytes):
                found = search_shard(texts[a:b], phrases)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.int64()),
                     pa.array([[{"start": s, "stop": e} for s, e in f[1]] for f in found], span), pa.array([sorted(f[2]) for f in found], pa.list_(pa.string()))],
                    [*part.schema.names, "n_words", "spans", "items"])

    return base.mapInArrow(search, schema)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])
    return find(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
