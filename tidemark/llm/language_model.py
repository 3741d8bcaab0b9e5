"""A hierarchical Pitman-Yor language model whose restaurants are seated by Gibbs sampling.

Three levels of restaurants share parents. Each word that comes before another is a context with a
restaurant of its own, whose customers are the training tokens after it; each of its tables sends
one customer to the restaurant of words, which all contexts share; each table there sends one to
the word's spelling, a sequence of bytes with restaurants per context of two, one and no bytes. The
first word of a text comes after a text's end.

A sweep seats every dish of every restaurant given the sweep before (its parent's probability of
the dish, and the tables of its own restaurant): it starts from customers that came in one by one,
then takes customers out of their tables and seats them again, at least half as many
times as the dish has customers and at most ``VISITS`` times. Predictive probabilities are averaged over the sweeps
behind the first ones.

Where the rows are. Texts are cut into chunks of some MB with their distinct words numbered. Words
are dealt to G slices by hash, and pairs of words to G * G cells by the slices of both, so that a
frequent word's pairs lie in G or more cells and no cell grows with one word; G grows with the root
of the bytes. Chunks send their distinct pairs to the cells once, cells seat them and send the
slices sums of tables per word, slices seat the words and send back probabilities, all as packed
arrays. At the end cells send each chunk its pairs' customers and tables, and slices its words'.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, binary_column, column_like, fold, pieces, release
from tidemark.session import stored

CHUNK = 8 << 20  # bytes of texts whose words are numbered together
CELL = 6 << 20  # bytes of text per cell of pairs, on average
SWEEPS, BURN = 3, 1
STRENGTH, SPELL_DISCOUNT = 1.0, 0.5
SYMBOLS = 257  # bytes, and the border of a word
BORDER = 256
END = b"\n"  # the end of a text as a token; no word has this byte
BLOCK = 32  # the start seats 1/32 of a dish's customers at a time beyond 32 of them
VISITS = 32  # customers of a dish that a sweep takes out and seats again, at most


# ---- rows of packed arrays -------------------------------------------------------------------

ROW = "key bigint, kind int, other bigint, data array<binary>"
_ROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("other", pa.int64()), ("data", pa.list_(pa.binary()))])
TEXT, WORDS, LINK, PAIRS, PLACES, FOLLOWERS, VISITORS, TABLES, CHANCES, SPELLED = range(10)
Row = tuple[int, int, int, list[bytes]]


def pack(numbers: np.ndarray, kind: str = "<i8") -> bytes:
    """Numbers as planes of bytes, compressed; planes of zeros cost nothing."""
    values = np.ascontiguousarray(numbers, kind)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: str = "<i8") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def _batch(rows: Iterable[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)


def by_key(
    rows: DataFrame, work: Callable[[int, list[tuple[int, int, list[bytes]]]], Iterator[tuple]], schema: str = ROW,
    batch_of: Callable[[list[tuple]], pa.RecordBatch] = _batch,
) -> DataFrame:
    """``work`` on the rows of each key, in the order of kind and other; keys must stay small enough for a task.

    ``batch_of`` makes the rows of ``schema`` from what it yields.
    """

    def done(key, held):
        if out := list(work(key, held)):
            yield batch_of(out)
        held.clear()
        out = None
        release()

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one row's bytes at a time
                if held and row["key"] != key:
                    yield from done(key, held)
                key = row["key"]
                held.append((row["kind"], row["other"], row["data"]))
        if held:
            yield from done(key, held)

    return rows.repartition("key").sortWithinPartitions("key", "kind", "other").mapInArrow(run, schema)


def of_kind(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


# ---- chunks and words ------------------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def cut(docs: DataFrame, g: int) -> DataFrame:
    """A TEXT row per chunk with its documents and token numbers, and a WORDS row per slice and chunk: the chunk's words there, their numbers and training occurrences."""

    def rows(chunk, texts, ids, held):
        number = _Numbers({END: 0})
        get, parts = number.__getitem__, []
        for text in texts:
            words = text.translate(LOWER).split()
            words.append(END)
            parts.append(np.fromiter(map(get, words), np.uint32, len(words)))
        lengths = np.array([len(p) for p in parts])
        tokens = np.concatenate(parts)
        train = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(number))
        order = np.argsort(-np.bincount(tokens, minlength=len(number)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        void = ids.is_null().to_numpy(zero_copy_only=False)
        yield chunk, TEXT, 0, [pack(rank[tokens], "<u4"), pack(lengths), pack(held, "u1"), pack(ids.cast(pa.int64()).fill_null(0).to_numpy()), pack(void, "u1")]
        words = list(number)
        slices = np.fromiter(map(crc32, words), np.int64, len(words)) % g
        by_slice = np.argsort(slices, kind="stable")
        for s, some in zip(*_groups(slices[by_slice], by_slice)):
            yield int(s), WORDS, chunk, [zstandard.compress(b" ".join([words[i] for i in some.tolist()]), 1), pack(rank[some]), pack(train[some])]

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids, held = binary_column(batch, "text"), column_like(batch, "doc_id"), column_like(batch, "held").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in pieces(np.array([len(t) for t in texts], np.int64), CHUNK):
                yield _batch(rows(chunk, texts[a:b], ids.slice(a, b - a), held[a:b]))
                chunk += 1
                release()

    return docs.select("doc_id", "held", "text").mapInArrow(run, ROW)


def _groups(keys: np.ndarray, *columns: np.ndarray) -> tuple:
    """The distinct keys of sorted ones, and each column cut accordingly."""
    borders = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[borders], *(np.split(c, borders[1:]) for c in columns)


def slices(chunks: DataFrame) -> DataFrame:
    """Per slice a WORDS row (its words, training occurrences) and a LINK row per chunk (places in the slice, numbers in the chunk)."""

    def work(key, held):
        number = _Numbers()
        get, places, times = number.__getitem__, [], []
        for _, _, data in held:
            words = words_of(data[0])
            places.append(np.fromiter(map(get, words), np.int64, len(words)))
            times.append(unpack(data[2]))
        customers = np.bincount(np.concatenate(places), np.concatenate(times))
        yield key, WORDS, 0, [zstandard.compress(b" ".join(number)), pack(customers)]
        for (_, chunk, data), place in zip(held, places):
            order = np.argsort(place)
            yield key, LINK, chunk, [pack_sorted(place[order]), pack(unpack(data[1])[order])]

    return by_key(of_kind(chunks, WORDS), work)


def words_of(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ")


def _numbered(rows: list, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple, list[bytes]]:
    """Of a chunk's TEXT and LINK rows: its distinct pairs' cells and keys in order, which pair each token is, training tokens, the pairs' words, the text."""
    text = next(d for k, _, d in rows if k == TEXT)
    links = [(s, unpack_sorted(d[0]), unpack(d[1])) for k, s, d in rows if k == LINK]
    n = sum(len(p) for _, p, _ in links)
    of, place = np.empty(n, np.int64), np.empty(n, np.int64)
    for s, places, locals_ in links:
        of[locals_], place[locals_] = s, places
    tokens, lengths = unpack(text[0], "<u4"), unpack(text[1])
    before = np.roll(tokens, 1)
    before[np.cumsum(lengths) - lengths] = tokens[-1]  # each text ends with END, and comes after one
    ordered = np.lexsort((place, of))
    rank = np.empty(n, np.int64)
    rank[ordered] = np.arange(n)
    pairs, which = np.unique(rank[before] * n + rank[tokens], return_inverse=True)
    u, w = ordered[pairs // n], ordered[pairs % n]
    cells = of[u] * g + of[w]
    order = np.argsort(cells, kind="stable")  # pairs of a cell stay in the order of their places
    at = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    at[order] = np.arange(len(order))
    u, w = u[order], w[order]
    return cells[order], place[u] << 32 | place[w], at[which], np.repeat(unpack(text[2], "u1") == 0, lengths), (u, w), text


def cells_of(rows: DataFrame, g: int) -> DataFrame:
    """PAIRS rows per cell (keys in order, training occurrences), and a PLACES row per cell and chunk: where the chunk's pairs are among them."""

    def send(chunk, held):
        cells, keys, which, train, _, _ = _numbered(held, g)
        times = np.bincount(which[train], minlength=len(keys))
        for cell, own, n in zip(*_groups(cells, keys, times)):
            yield int(cell), PAIRS, chunk, [pack_sorted(own), pack(n)]

    def merge(cell, held):
        each = [unpack_sorted(d[0]) for _, _, d in held]
        keys, places = np.unique(np.concatenate(each), return_inverse=True)
        times = np.bincount(places, np.concatenate([unpack(d[1]) for _, _, d in held]))
        yield cell, PAIRS, 0, [pack_sorted(keys), pack(times)]
        at = 0
        for (_, chunk, _), own in zip(held, each):
            yield cell, PLACES, chunk, [pack_sorted(places[at:at + len(own)])]
            at += len(own)

    return by_key(by_key(rows, send), merge)


# ---- seating ---------------------------------------------------------------------------------


def seat(customers: np.ndarray, discount: float, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers came in one by one.

    ``weight`` is that of a new table, (strength + discount * tables of the restaurant) times the
    parent's probability of the dish; it is held over the dish's customers. So is, beyond ``BLOCK``
    customers, the number of tables over the next 1/32 of them.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    here = np.flatnonzero(customers > 1)
    left, t, w = customers[here], tables[here], weight[here]
    n = 1
    while len(here):
        m = np.minimum(max(1, n // BLOCK), left - n)
        t = t + rng.binomial(m, w / (w + n - discount * t))
        n += max(1, n // BLOCK)
        done = left <= n
        if done.any():
            tables[here[done]] = t[done]
            here, left, t, w = here[~done], left[~done], t[~done], w[~done]
    return tables


def reseat(customers: np.ndarray, tables: np.ndarray, discount: float, weight: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after ``rounds`` Gibbs steps: a random customer is taken out and seated again given the others.

    All dishes have two customers or more. They start with one large table and single guests at
    the other ones. The customer sits at a table of n with probability proportional to n -
    discount, at a new one to ``weight``.
    """
    tables = tables.astype(np.int64)
    room = np.minimum(customers, tables + rounds)
    first = np.cumsum(room) - room
    sizes = np.zeros(int(room.sum()), np.int64)
    sizes[np.repeat(first, tables) + np.arange(tables.sum()) - np.repeat(np.cumsum(tables) - tables, tables)] = 1
    sizes[first] += customers - tables
    for _ in range(rounds):
        reach = np.cumsum(sizes)
        k = np.searchsorted(reach, reach[first] - sizes[first] + rng.integers(0, customers), "right")
        sizes[k] -= 1
        gone = np.flatnonzero(sizes[k] == 0)
        last = first[gone] + tables[gone] - 1
        sizes[k[gone]], sizes[last] = sizes[last], 0  # its place goes to the last table
        tables[gone] -= 1
        mass = customers - 1 - discount * tables
        fresh = rng.random(len(tables)) * (weight + mass) < weight
        shares = sizes - discount * (sizes > 0)
        reach = np.cumsum(shares)
        k = np.searchsorted(reach, reach[first] - shares[first] + rng.random(len(tables)) * mass, "right")
        k = np.where(fresh, first + tables, np.clip(k, first, first + tables - 1))
        sizes[k] += 1
        tables += fresh
    return tables


def sweep_dishes(customers: np.ndarray, discount: float, weight: np.ndarray, rng: np.random.Generator, visits: int = VISITS) -> np.ndarray:
    """Tables of each dish after one sweep; dishes of like numbers of customers go through as many steps as those."""
    tables = seat(customers, discount, weight, rng)
    size = np.frexp(customers.astype(float))[1]
    for bits in np.unique(size[customers > 1]):
        here = np.flatnonzero((size == bits) & (customers > 1))
        tables[here] = reseat(customers[here], tables[here], discount, weight[here], int(min(visits, 1 << int(bits) - 1)), rng)
    return tables


@dataclass
class Spelling:
    """Predictive probabilities of the byte restaurants: seen cells by sorted key, and what falls back on shorter contexts."""

    keys: np.ndarray  # (two bytes of context * SYMBOLS + byte), sorted
    seen: np.ndarray  # the seen part of their probability
    back: np.ndarray  # per context of two: the share that goes to the context of one
    parent: np.ndarray  # per context of one and byte: its probability, dense

    @classmethod
    def uniform(cls) -> Spelling:
        empty = np.zeros(0)
        return cls(empty.astype(np.int64), empty, np.ones(SYMBOLS * SYMBOLS), np.full(SYMBOLS * SYMBOLS, 1 / SYMBOLS))

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        seen = np.where(self.keys[at] == keys, self.seen[at], 0.0) if len(self.keys) else 0.0
        return seen + self.back[keys // SYMBOLS] * self.parent[keys % (SYMBOLS * SYMBOLS)]


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of the words and of their ends, and where each word begins."""
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.full(int((lengths + 1).sum()), BORDER, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[starts + lengths] = False
    symbols[inside] = np.frombuffer(b"".join(words), np.uint8)
    one = np.concatenate([[BORDER], symbols[:-1]])
    two = np.concatenate([[BORDER], one[:-1]])
    two[starts] = BORDER  # the word before doesn't count
    return (two * SYMBOLS + one) * SYMBOLS + symbols, starts


def _predictive(cell_customers, cell_tables, group, groups, discount, strength):
    """The seen part of each cell's probability, and each restaurant's share for its parent."""
    customers, tables = np.bincount(group, cell_customers, groups), np.bincount(group, cell_tables, groups)
    seen = (cell_customers - discount * cell_tables) / (strength + customers[group])
    return seen, (strength + discount * tables) / (strength + customers)


def seat_spelling(keys: np.ndarray, customers: np.ndarray, before: Spelling, rng: np.random.Generator, discount: float = SPELL_DISCOUNT, strength: float = STRENGTH) -> Spelling:
    """One sweep over the byte restaurants, longest contexts first; ``before`` gives their parents' probabilities."""
    n1, n0 = SYMBOLS * SYMBOLS, SYMBOLS
    context = keys // SYMBOLS
    totals = np.bincount(context, minlength=n1)  # dishes of each restaurant, a lower bound of its tables
    t2 = seat(customers, discount, (strength + discount * totals[context]) * before.parent[keys % n1], rng)
    c1 = np.bincount(keys % n1, t2, n1).astype(np.int64)
    have1 = np.flatnonzero(c1)
    uniform = np.full(n0, 1 / n0)
    c0_parent = np.maximum(np.bincount(have1 % n0, c1[have1], n0), 1e-3)
    dishes1 = np.bincount(have1 // n0, minlength=n0)
    t1 = seat(c1[have1], discount, (strength + discount * dishes1[have1 // n0]) * (c0_parent / c0_parent.sum())[have1 % n0], rng)
    c0 = np.bincount(have1 % n0, t1, n0).astype(np.int64)
    t0 = seat(c0, discount, (strength + discount * (c0 > 0).sum()) * uniform, rng)
    seen0, back0 = _predictive(c0, t0, np.zeros(n0, np.int64), 1, discount, strength)
    p0 = seen0 + back0[0] * uniform
    seen1, back1 = _predictive(c1[have1], t1, have1 // n0, n0, discount, strength)
    p1 = np.repeat(back1, n0) * np.tile(p0, n0)
    p1[have1] += seen1
    seen2, back2 = _predictive(customers, t2, context, n1, discount, strength)
    return Spelling(keys, seen2, back2, p1)


@dataclass
class Sample:
    """What one sweep leaves: the parts of a word's probability that all words share, and where its rows are."""

    customers: int  # of the restaurant of words
    tables: int
    known: float  # probability that the spelling gives to all training words together
    discount: float
    strength: float
    words: DataFrame  # per slice: TABLES (followers' tables as a context, customers, tables, spelled probabilities)
    pairs: DataFrame  # per cell: TABLES

    def shares(self) -> tuple[int, int, float, float, float]:
        return self.customers, self.tables, self.known, self.discount, self.strength


def chances(customers: np.ndarray, tables: np.ndarray, spelled_as: np.ndarray, trained: np.ndarray, shares: tuple) -> np.ndarray:
    """A word's probability where no context is known; that of a word that never trained is that of all such words together, as in the plain model."""
    total, total_tables, known, discount, strength = shares
    p = np.where(trained, spelled_as, max(1e-12, 1 - known))
    return (customers - discount * tables + (strength + discount * total_tables) * p) / (strength + total)


def _after(rng_key: list[int]) -> np.random.Generator:
    return np.random.default_rng(rng_key)  # named by seed, sweep and key, so a lost task seats alike


def sweep_pairs(cells: DataFrame, messages: DataFrame, g: int, discount: float, strength: float, seed: list[int]) -> DataFrame:
    """Seats all context restaurants: TABLES per cell, and per cell the sums of tables by context (FOLLOWERS) and by word (VISITORS) for the slices."""

    def work(cell, held):
        found = {kind: data for kind, _, data in held}
        if PAIRS not in found:
            return
        keys, times = unpack_sorted(found[PAIRS][0]), unpack(found[PAIRS][1])
        u, w = keys >> 32, keys & 0xFFFFFFFF
        weight = (strength + discount * unpack(found[FOLLOWERS][0])[u]) * unpack(found[CHANCES][0], "<f4")[w]
        tables = np.zeros(len(keys), np.int64)
        seen = np.flatnonzero(times)
        tables[seen] = sweep_dishes(times[seen], discount, weight[seen], _after([*seed, cell]))
        yield cell, TABLES, 0, [pack(tables)]
        yield cell // g, FOLLOWERS, cell, [pack(np.bincount(u, tables))]
        yield cell % g, VISITORS, cell, [pack(np.bincount(w, tables))]

    return by_key(of_kind(cells, PAIRS).unionByName(messages), work)


def _sums(held: list, kind: int, n: int) -> np.ndarray:
    total = np.zeros(n, np.int64)
    for k, _, data in held:
        if k == kind:
            part = unpack(data[0])
            total[:len(part)] += part
    return total


def sweep_words(words: DataFrame, sent: DataFrame, spelling: Spelling, tables_before: int, discount: float, strength: float, seed: list[int]) -> DataFrame:
    """Seats the restaurant of words, whose customers are the contexts' tables: TABLES per slice, and the customers of the bytes of its words (SPELLED)."""

    def work(key, held):
        data = next(d for k, _, d in held if k == WORDS)
        texts = words_of(data[0])
        customers = _sums(held, VISITORS, len(texts))
        spells, starts = spelled(texts)
        p = np.exp(np.add.reduceat(np.log(spelling.of(spells)), starts))
        tables = np.zeros(len(texts), np.int64)
        seen = np.flatnonzero(customers)
        tables[seen] = sweep_dishes(customers[seen], discount, (strength + discount * tables_before) * p[seen], _after([*seed, key]))
        yield key, TABLES, 0, [pack(_sums(held, FOLLOWERS, len(texts))), pack(customers), pack(tables), pack(p, "<f4")]
        cells, where = np.unique(spells, return_inverse=True)
        sums = np.bincount(where, np.repeat(tables, np.diff(np.append(starts, len(spells)))), len(cells))
        some = sums > 0
        yield key, SPELLED, 0, [pack(np.concatenate([cells[some], [-3, -2, -1]])), pack(np.concatenate([sums[some], [customers.sum(), p[seen].sum(), tables.sum()]]), "<f8")]

    return by_key(of_kind(words, WORDS).unionByName(of_kind(sent, FOLLOWERS, VISITORS)), work)


def spelling_customers(seated: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Customers of the byte restaurants, at most 257 ** 3 sums, and under -3, -2 and -1 those of words, the known probability and the tables."""

    def opened(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpack(row["data"][0])), pa.array(unpack(row["data"][1], "<f8"))], ["cell", "n"])

    rows = of_kind(seated, SPELLED).mapInArrow(opened, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, sums = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(cells)
    cells, sums = cells[order], sums[order]
    return cells[cells >= 0], sums[cells >= 0].astype(np.int64), dict(zip(cells[cells < 0].tolist(), sums[cells < 0].tolist()))


def messages_of(words: DataFrame, g: int, values: Callable[[dict], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Each slice's tables as contexts to the cells of its row, its words' probabilities to those of its column."""

    def work(key, held):
        followers, p = values({kind: data for kind, _, data in held})
        left, right = [pack(followers)], [pack(p, "<f4")]
        for other in range(g):
            yield key * g + other, FOLLOWERS, 0, left
            yield other * g + key, CHANCES, 0, right

    return by_key(words, work)


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / max(1, once + 2 * twice)))


def _facts(rows: DataFrame, kind: int) -> dict[str, int]:
    """Of the training counts in rows of a kind: their sum, and how many are over zero, one and two."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = unpack(row["data"][1])
                yield pa.RecordBatch.from_pylist([dict(n=int(n.sum()), types=int((n > 0).sum()), once=int((n == 1).sum()), twice=int((n == 2).sum()))])

    names = ("n", "types", "once", "twice")
    found = of_kind(rows, kind).mapInArrow(run, "n bigint, types bigint, once bigint, twice bigint").agg(*[F.sum(c).alias(c) for c in names]).first()
    return {c: found[c] or 0 for c in names}


def fit(words: DataFrame, cells: DataFrame, g: int, facts: dict[str, int], seed: int = 11, sweeps: int = SWEEPS, burn: int = BURN, strength: float = STRENGTH) -> tuple[float, list[Sample]]:
    """The contexts' discount, and the samples of Gibbs sweeps over stored words and pairs."""
    pairs = _facts(cells, PAIRS)
    pair_discount, word_discount = discount_of(pairs["once"], pairs["twice"]), discount_of(facts["once"], facts["twice"])
    floor = facts["n"] + 0.5 * (facts["types"] + 1)

    def at_first(found):
        customers = unpack(found[WORDS][1])
        return np.ceil(customers ** 0.7), (customers + 0.5) / floor

    messages, spelling, tables, samples = messages_of(of_kind(words, WORDS), g, at_first), Spelling.uniform(), facts["types"], []
    for sweep in range(sweeps):
        sent = stored(sweep_pairs(cells, messages, g, pair_discount, strength, [seed, sweep, 0]), "pairs")
        seated = stored(sweep_words(words, sent, spelling, tables, word_discount, strength, [seed, sweep, 1]), "words")
        keys, customers, sums = spelling_customers(seated)
        sample = Sample(int(sums.get(-3, 0)), int(sums.get(-1, 0)), sums.get(-2, 0.0), word_discount, strength, of_kind(seated, TABLES), of_kind(sent, TABLES))
        if len(keys):
            spelling = seat_spelling(keys, customers, spelling, np.random.default_rng([seed, sweep]), strength=strength)
        tables, shares = sample.tables, sample.shares()
        if sweep >= burn:
            samples.append(sample)

        def of_sweep(found, shares=shares):
            followers, customers, seats, p = (unpack(d, k) for d, k in zip(found[TABLES], ("<i8", "<i8", "<i8", "<f4")))
            return followers, chances(customers, seats, p, customers > 0, shares)

        messages = messages_of(of_kind(seated, TABLES), g, of_sweep)
    return pair_discount, samples


# ---- texts -----------------------------------------------------------------------------------


def _tagged(rows: DataFrame, number: int) -> DataFrame:
    return rows.withColumn("other", F.lit(number).cast("bigint"))


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score_texts(docs: DataFrame, seed: int = 11, cell: int = CELL) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    ``docs`` has doc_id, held (whether the document is kept out of training) and text. Null and
    empty texts are their end alone; very long ones are a chunk by themselves; repeated rows train
    and are scored each; a null id is fine; an empty table gives no rows. Without training texts
    words are all unknown.
    """
    g = max(1, math.ceil(math.sqrt((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / cell)))
    chunks = stored(cut(docs, g), "chunks")
    words = stored(slices(chunks), "slices")
    facts = _facts(words, WORDS)
    texts = of_kind(chunks, TEXT)
    links = of_kind(words, LINK).select(F.col("other").alias("key"), "kind", F.col("key").alias("other"), "data")
    cells = stored(cells_of(texts.unionByName(links), g), "cells")
    discount, samples = fit(words, cells, g, facts, seed)
    shares, strength = [s.shares() for s in samples], STRENGTH

    def to_chunks(key, held):
        customers = unpack(next(d for k, _, d in held if k == WORDS)[1])
        found = []
        for n, data in ((n, d) for k, n, d in held if k == TABLES):
            followers, seats_of, seats, p = (unpack(d, k) for d, k in zip(data, ("<i8", "<i8", "<i8", "<f4")))
            found += [(followers, "<i8"), (chances(seats_of, seats, p, customers > 0, shares[n]), "<f4")]
        for kind, chunk, data in held:
            if kind == LINK:
                places = unpack_sorted(data[0])
                yield chunk, LINK, key, [*data, pack(customers[places]), *(pack(v[places], k) for v, k in found)]

    def pairs_to_chunks(key, held):
        times = unpack(next(d for k, _, d in held if k == PAIRS)[1])
        tables = [unpack(d[0]) for k, _, d in held if k == TABLES]
        for kind, chunk, data in held:
            if kind == PLACES:
                places = unpack_sorted(data[0])
                yield chunk, PAIRS, key, [pack(times[places]), *(pack(t[places]) for t in tables)]

    back = by_key(words.unionByName(_all(_tagged(s.words, n) for n, s in enumerate(samples))), to_chunks)
    pairs = by_key(cells.unionByName(_all(_tagged(s.pairs, n) for n, s in enumerate(samples))), pairs_to_chunks)
    floor = math.log10(facts["n"] + 0.5 * (facts["types"] + 1))

    def add_up(chunk, held):
        _, _, which, _, (u, w), text = _numbered(held, g)
        n = sum(len(unpack(d[1])) for k, _, d in held if k == LINK)
        customers, followers, p = np.zeros(n, np.int64), np.zeros((len(shares), n)), np.zeros((len(shares), n))
        for kind, _, data in held:
            if kind == LINK:
                at = unpack(data[1])
                customers[at] = unpack(data[2])
                for i in range(len(shares)):
                    followers[i, at], p[i, at] = unpack(data[3 + 2 * i]), unpack(data[4 + 2 * i], "<f4")
        found = [[unpack(v) for v in d] for k, _, d in held if k == PAIRS]  # by cell, as the pairs are
        times, *tables = (np.concatenate(v) for v in zip(*found))
        total = np.zeros(len(u))
        for i, seats in enumerate(tables):
            total += (times - discount * seats + (strength + discount * followers[i][u]) * p[i][w]) / (strength + customers[u])
        score, base, known = np.log10(total / len(tables)), np.log10(customers + 0.5)[w] - floor, (customers > 0)[w]
        lengths = unpack(text[1])
        starts = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(v[which].astype(k), starts) for v, k in ((known, np.int64), (base, float), (score, float))]
        yield unpack(text[3]), unpack(text[4], "u1"), unpack(text[2], "u1"), lengths, *sums

    def scored(chunks):
        ids, void, held, *columns = map(np.concatenate, zip(*chunks))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=void > 0), pa.array(held > 0), *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = by_key(texts.unionByName(back).unionByName(pairs), add_up, SCORED, scored)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts["n"]).cast("bigint").alias("train_tokens"), "base_score", "score")


def _all(frames: Iterable[DataFrame]) -> DataFrame:
    whole, *others = frames
    for frame in others:
        whole = whole.unionByName(frame)
    return whole


def score_documents(docs: DataFrame) -> DataFrame:
    """All documents, learned from those whose fold isn't 1."""
    return score_texts(docs.select("doc_id", (fold("doc_id") == 1).alias("held"), "text"))


def perplexity(scored: DataFrame, column: str = "score") -> float:
    """Per token, over the documents that were held out."""
    row = scored.where("held_out").agg(F.sum(column), F.sum("n_tokens")).first()
    return 10 ** (-row[0] / row[1]) if row[1] else float("nan")
