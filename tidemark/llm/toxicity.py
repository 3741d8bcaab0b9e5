"""A convolutional network over hashed words that scores the toxicity of whole texts.

A word is a run of letters and digits; its hash and the hash of its first bytes each name a row of
one embedding table, and the two rows add up to the word's vector. Filters of several widths run
over the words, each filter's largest response over the whole text enters one logistic unit.

All labelled rows that aren't held out are learned from, whatever their number and length. They are
dealt over partitions; in each pass every partition trains a copy of the net on its rows, and the
copies are averaged. A part of the rows is kept from training: on it the scores are calibrated, so
that the best cutoff for all lies at ``THRESHOLD``, and a threshold is chosen for each language.
Language decides about thresholds only, never about a score.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PLAIN_WORDS, column_like, flat_column, fold, pieces
from tidemark.session import checkpointed, stored

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
START = 0.005  # scale of the embedding before training: words that never trained stay near nothing
TAPS = sum(WIDTHS)
HEAD = 5  # bytes of a word that its second hash covers
PADS = max(WIDTHS) - 1  # rows of nothing behind each text
ROWS = 16_000  # rows that one copy of the net trains on in a pass
BLOCKS = 16  # parts of the embedding that are averaged by themselves
FEW_LABELS = 1_000_000  # labelled ids that are broadcast
GRID = 1000  # steps of a logit in which the scores of calibration rows are counted
CALIBRATION = 5  # one of so many labelled rows is kept for calibration
LEAST_TOXIC = 10  # a language with fewer toxic calibration rows takes the threshold of all
EPOCHS, BATCH, RATE, DECAY = 14, 64, 1e-2, 1e-5
BLOCK_BYTES = 1 << 17  # bytes of text whose words are held at once
BLOCK_WORDS = 1 << 15  # words whose responses are held at once in training
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7

_PLAIN = np.frombuffer(PLAIN_WORDS, np.uint8)
_RANDOM = np.random.default_rng(1207).integers(1, 2**63, 260, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_ids(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of the embedding table per word, from 1 on, and the first word of each text (n + 1 numbers)."""
    none = np.zeros((0, 2), np.int32), np.zeros(len(borders), np.int64)
    if not len(data):
        return none
    low = _PLAIN[data]
    inside = low != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = borders[:-1][borders[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    lengths = np.diff(np.concatenate([starts, [len(data)]]))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()), _RANDOM[256], np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = np.where(inside, _RANDOM[low], np.uint64(0))[starts[0]:] * powers[place]
    at = starts - starts[0]
    whole = np.add.reduceat(values, at)
    head = np.add.reduceat(np.where(place < HEAD, values, np.uint64(0)), at) * _RANDOM[257]

    def row(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * _RANDOM[258]
        return ((h >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int32) + 1

    return np.stack([row(whole), row(head)], axis=1), np.searchsorted(starts, borders)


@dataclass
class Net:
    embedding: np.ndarray  # BUCKETS + 1 x DIM; row 0 stands for nothing
    taps: np.ndarray  # TAPS x DIM x FILTERS: those of width 1, then 2, ...
    bias: np.ndarray  # one per width and filter
    unit: np.ndarray
    offset: np.ndarray  # 1

    @classmethod
    def new(cls, seed: int) -> Net:
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return rng.standard_normal(shape).astype(np.float32)

        embedding = normal(BUCKETS + 1, DIM) * np.float32(START)
        embedding[0] = 0
        taps = normal(TAPS, DIM, FILTERS) * np.float32((2 / DIM) ** 0.5)
        n = len(WIDTHS) * FILTERS
        return cls(embedding, taps, np.zeros(n, np.float32), np.abs(normal(n)) * np.float32(0.1), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def laid_out(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts with PADS rows of nothing behind each text, where each text starts, and which rows start a window.

    A text of no words has one window, over nothing.
    """
    counts = np.diff(first)
    rooms = np.maximum(counts, 1) + PADS
    at = np.concatenate([[0], np.cumsum(rooms)])
    flat = np.zeros((int(at[-1]) + PADS, 2), np.int32)
    where = np.arange(len(ids)) + np.repeat(at[:-1] - first[:-1], counts)
    flat[where] = ids
    opens = np.zeros(int(at[-1]), bool)
    opens[where] = True
    opens[at[:-1]] = True
    return flat, at[:-1], opens


def responses(per_word: np.ndarray, n: int) -> np.ndarray:
    """Responses of all filters to the windows at the first ``n`` words, from each word's response to every tap."""
    out = np.empty((n, len(WIDTHS) * FILTERS), per_word.dtype)
    tap = 0
    for k, width in enumerate(WIDTHS):
        mine = out[:, k * FILTERS:(k + 1) * FILTERS]
        mine[:] = per_word[:n, tap]
        for j in range(1, width):
            mine += per_word[j:j + n, tap + j]
        tap += width
    return out


def table(net: Net) -> np.ndarray:
    """Each embedding row's response to every tap."""
    return np.einsum("ed,tdf->etf", net.embedding, net.taps, optimize=True).astype(np.float32)


def maxima(rows: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each filter's largest response in each text, before bias and cut; ``rows`` is the table of the net."""
    flat, at, opens = laid_out(ids, first)
    found = responses(rows[flat[:, 0]] + rows[flat[:, 1]], len(opens))
    found[~opens] = -np.inf
    return np.maximum.reduceat(found, at, axis=0)


def long_maxima(rows: np.ndarray, data: np.ndarray, block: int) -> np.ndarray:
    """``maxima`` of one text of any length: it is cut between words, and each part starts with the last words of the one before."""
    blank = _PLAIN == 32
    best = np.full((1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    carried, start = np.zeros((0, 2), np.int32), 0
    while start < len(data):
        end = min(start + block, len(data))
        while end < len(data) and not blank[data[end]]:
            end += 1
        ids, _ = word_ids(data[start:end], np.array([0, end - start]))
        ids, start = np.concatenate([carried, ids]), end
        carried = ids[len(ids) - min(PADS, len(ids)):]
        ready = len(ids) - PADS  # windows that have all their words
        if ready > 0:
            found = responses(rows[ids[:, 0]] + rows[ids[:, 1]], ready)
            np.maximum(best, found.max(axis=0), out=best)
    return np.maximum(best, maxima(rows, carried, np.array([0, len(carried)])))


def logits(net: Net, rows: np.ndarray, data: np.ndarray, borders: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
    """The logit of each text. Short texts share blocks, one above ``block`` bytes is read in parts."""
    best = np.empty((len(borders) - 1, len(WIDTHS) * FILTERS), np.float32)
    for a, b in pieces(np.diff(borders), block):
        here = data[borders[a]:borders[b]]
        best[a:b] = long_maxima(rows, here, block) if len(here) > block else maxima(rows, *word_ids(here, borders[a:b + 1] - borders[a]))
    return np.maximum(best + net.bias, 0) @ net.unit + net.offset[0]


def best_windows(net: Net, ids: np.ndarray, first: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in each text, and the embedding rows of the words in that window (of ties the first)."""
    filters = len(WIDTHS) * FILTERS
    top, rows = np.empty((len(first) - 1, filters), net.embedding.dtype), np.zeros((len(first) - 1, filters, max(WIDTHS), 2), np.int32)
    taps = net.taps.transpose(1, 0, 2).reshape(DIM, -1)

    def largest(ids: np.ndarray, first: np.ndarray, starts: int | None = None):
        flat, at, opens = laid_out(ids, first)
        if starts is not None:
            opens[starts:] = False
        per_word = ((net.embedding[flat[:, 0]] + net.embedding[flat[:, 1]]) @ taps).reshape(len(flat), TAPS, FILTERS)
        found = responses(per_word, len(opens))
        found[~opens] = -np.inf
        best = np.maximum.reduceat(found, at, axis=0)
        text = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(opens))))
        places = np.where(found == best[text], np.arange(len(opens))[:, None], len(opens))
        return best, flat[np.minimum.reduceat(places, at, axis=0)[:, :, None] + np.arange(max(WIDTHS))]

    for a, b in pieces(np.diff(first), block):
        here = ids[first[a]:first[b]]
        if len(here) <= block:
            top[a:b], rows[a:b] = largest(here, first[a:b + 1] - first[a])
            continue
        top[a] = -np.inf  # one long text, in parts that reach into the next one by the length of a window
        for start in range(0, len(here), block):
            part = here[start:start + block + PADS]
            best, where = largest(part, np.array([0, len(part)]), block if start + block < len(here) else None)
            more = best[0] > top[a]
            top[a, more], rows[a, more] = best[0, more], where[0, more]
    return top, rows


def gradients(net: Net, ids: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray, block: int = BLOCK_WORDS) -> tuple[float, list[np.ndarray]]:
    """Weighted log loss of a batch, and its derivative by each parameter."""
    top, rows = best_windows(net, ids, first, block)
    words = net.embedding[rows[..., 0]] + net.embedding[rows[..., 1]]
    raw = top + net.bias
    hidden = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-(hidden @ net.unit + net.offset[0]).astype(np.float64)))
    loss = -np.sum(weights * np.log(np.where(labels == 1, p, 1 - p) + 1e-7)) / weights.sum()
    d_logit = (weights * (p - labels) / weights.sum()).astype(net.unit.dtype)
    d_raw = d_logit[:, None] * net.unit * (raw > 0)
    d_taps, d_embedding = np.zeros_like(net.taps), np.zeros_like(net.embedding)
    tap = 0
    for k, width in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        g = d_raw[:, own]
        for j in range(width):
            d_taps[tap + j] = np.einsum("nf,nfd->df", g, words[:, own, j])
            spread = g[:, :, None] * net.taps[tap + j].T  # text, filter, dimension
            for column in (0, 1):
                np.add.at(d_embedding, rows[:, own, j, column], spread)
        tap += width
    d_embedding[0] = 0
    return float(loss), [d_embedding, d_taps, d_raw.sum(axis=0), d_logit @ hidden, d_logit.sum(keepdims=True)]


def constant(share: float) -> Net:
    """A net that gives every text the same score."""
    net = Net.new(0)
    net.unit[:] = 0
    net.offset[0] = np.log(share / (1 - share))
    return net


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


# ---- learning from all labelled rows ---------------------------------------------------------


def learned(docs: DataFrame, labels: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Rows (lang, toxic, words) to train on, those to calibrate on, and how many of both each class has.

    All labelled rows that aren't held out; ``words`` are the embedding rows of the text's words.
    Rows that stand twice count once; an id with both labels counts as toxic. Training rows stand
    in partitions of ROWS at most and in an order by a hash; both are kept in the shared folder.
    """

    def cut(batches):
        names = ["doc_id", "hash", "lang", "toxic", "words"]
        for batch in batches:
            data, borders = flat_column(batch, "text")
            for a, b in pieces(np.diff(borders), 16 * BLOCK_BYTES):
                ids, first = word_ids(data[borders[a]:borders[b]], borders[a:b + 1] - borders[a])
                ids = ids.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [*(column_like(batch, c).slice(a, b - a) for c in names[:-1]), pa.array([ids[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())], names)

    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    text = F.coalesce(F.col("text"), F.lit(""))
    mine = docs.where(fold("doc_id", FOLDS) != HELD_OUT).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", text.alias("text"), F.xxhash64(text).alias("hash"))
    known = known.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = mine.join(F.broadcast(known) if known.count() <= FEW_LABELS else known, "doc_id").select("doc_id", "hash", "lang", "toxic", "text")
    found = rows.mapInArrow(cut, "doc_id bigint, hash bigint, lang string, toxic int, words binary")
    found = stored(found.groupBy("doc_id", "hash", "toxic").agg(F.min("lang").alias("lang"), F.min("words").alias("words")), "labelled")
    counts = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
    kept = F.pmod(F.shiftright("hash", 7), F.lit(CALIBRATION)) == 0
    for_training = found.where(~kept)
    parts = max(1, -(-for_training.count() // ROWS))
    dealt = for_training.repartition(parts).sortWithinPartitions(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "hash")
    return checkpointed(dealt.select("toxic", "words")), found.where(kept).select("lang", "toxic", "words"), counts


def joined_words(batch: pa.RecordBatch, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the chosen rows, as ``word_ids`` gives them."""
    words = column_like(batch, "words")
    ids = [np.frombuffer(words[int(i)].as_buffer(), "<u2").reshape(-1, 2) for i in chosen]
    return np.concatenate(ids).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


STATE = "block int, part bigint, rows binary, state binary"


def one_pass(rows: DataFrame, net: Net, moments: list[np.ndarray], weights: dict[int, float], number: int, epochs: int, seed: int) -> None:
    """Trains ``net`` and Adam's ``moments`` in place: a copy on the rows of each partition, then the mean of the copies.

    Of an embedding row it is the mean of the copies that reached it, as the others know nothing new
    of it. The copies are averaged by blocks in tasks; the driver gets one net.
    """
    size = -(-(BUCKETS + 1) // BLOCKS)

    def run(batches):
        part, mine = TaskContext.get().partitionId(), Net(*[p.copy() for p in net.parameters()])
        own = [m.copy() for m in moments]
        held = [b for b in batches if b.num_rows]
        steps = sum(-(-b.num_rows // BATCH) for b in held)
        reached, done = np.zeros(BUCKETS + 1, bool), number * steps
        rng = np.random.default_rng([seed, number, part])
        for batch in held:
            y = column_like(batch, "toxic").to_numpy().astype(np.float32)
            w = np.where(y == 1, weights.get(1, 0), weights.get(0, 0)).astype(np.float32)
            order = rng.permutation(batch.num_rows)
            for a in range(0, len(order), BATCH):
                some = order[a:a + BATCH]
                _, slopes = gradients(mine, *joined_words(batch, some), y[some], w[some])
                done += 1
                rate = RATE * (1 - (done - 1) / (epochs * steps))
                for p, g, m, v in zip(mine.parameters(), slopes, own[::2], own[1::2]):
                    # of the embedding only the rows that the batch reaches
                    at = np.flatnonzero(g.any(axis=1)) if p is mine.embedding else slice(None)
                    if p is mine.embedding:
                        reached[at] = True
                    slope = g[at] + DECAY * p[at]
                    m[at] += 0.1 * (slope - m[at])
                    v[at] += 0.001 * (slope * slope - v[at])
                    p[at] -= rate * (m[at] / (1 - 0.9**done)) / (np.sqrt(v[at] / (1 - 0.999**done)) + 1e-8)
        if not steps:
            return
        small = np.concatenate([x.ravel() for x in [*mine.parameters()[1:], *own[2:]]])
        out = [(BLOCKS, part, b"", small.astype(np.float32).tobytes())]
        for block in range(BLOCKS):
            at = np.flatnonzero(reached[block * size:(block + 1) * size]) + block * size
            out.append((block, part, at.astype(np.int32).tobytes(), np.stack([mine.embedding[at], own[0][at], own[1][at]], axis=1).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["block", "part", "rows", "state"])

    def mean(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for block, at, state in zip(*(column_like(batch, c).to_pylist() for c in ("block", "rows", "state"))):
                state = np.frombuffer(state, np.float32).astype(np.float64)
                if block == BLOCKS:
                    total = sums.setdefault(block, [np.zeros(len(state)), 0])
                    total[0] += state
                    total[1] += 1
                else:
                    total = sums.setdefault(block, [np.zeros((size, 3, DIM)), np.zeros(size)])
                    at = np.frombuffer(at, np.int32) - block * size
                    total[0][at] += state.reshape(-1, 3, DIM)
                    total[1][at] += 1
        out = []
        for block, (total, times) in sums.items():
            if block == BLOCKS:
                out.append((block, 0, b"", (total / times).astype(np.float32).tobytes()))
            else:
                at = np.flatnonzero(times)
                out.append((block, 0, (at + block * size).astype(np.int32).tobytes(), (total[at] / times[at, None, None]).astype(np.float32).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["block", "part", "rows", "state"])

    copies = rows.mapInArrow(run, STATE).repartition("block").sortWithinPartitions("block", "part")
    for block, _, at, state in copies.mapInArrow(mean, STATE).collect():  # one net
        state = np.frombuffer(state, np.float32)
        if block < BLOCKS:
            at, state = np.frombuffer(at, np.int32), state.reshape(-1, 3, DIM)
            net.embedding[at], moments[0][at], moments[1][at] = state[:, 0], state[:, 1], state[:, 2]
            continue
        start = 0
        for x in [*net.parameters()[1:], *moments[2:]]:
            x[...] = state[start:start + x.size].reshape(x.shape)
            start += x.size


def train(rows: DataFrame, counts: dict[int, int], seed: int = 12, epochs: int = EPOCHS) -> Net:
    """Adam over all rows (toxic, words) in every pass; without two classes the net gives every text a constant.

    Weights give the classes the square root of their shares.
    """
    classes = {r["toxic"] for r in rows.select("toxic").distinct().collect()}
    if len(classes) < 2:
        return constant(0.5 if not classes else 0.98 if 1 in classes else 0.02)
    mean = sum(n**0.5 for n in counts.values()) / sum(counts.values())
    weights = {c: n**-0.5 / mean for c, n in counts.items()}
    net = Net.new(seed)
    moments = [np.zeros_like(p) for p in net.parameters() for _ in (0, 1)]
    for number in range(epochs):
        one_pass(rows, net, moments, weights, number, epochs, seed)
    return net


def counted_scores(rows: DataFrame, net: Net) -> list:
    """Rows (lang, toxic, score, times): how many calibration rows have that logit, in steps of 1 / GRID."""

    def run(batches):
        for batch in batches:
            top = np.zeros((0, len(WIDTHS) * FILTERS), np.float32)
            if batch.num_rows:
                top, _ = best_windows(net, *joined_words(batch, np.arange(batch.num_rows)), BLOCK_WORDS)
            found = np.maximum(top + net.bias, 0) @ net.unit + net.offset[0]
            score = np.rint(np.clip(found.astype(np.float64), -50, 50) * GRID) / GRID
            yield pa.RecordBatch.from_arrays([column_like(batch, "lang"), column_like(batch, "toxic"), pa.array(score)], ["lang", "toxic", "score"])

    found = rows.mapInArrow(run, "lang string, toxic int, score double")
    return found.groupBy("lang", "toxic", "score").agg(F.count("*").alias("times")).collect()


def best_cutoff(scores: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> float:
    """The middle of the widest cutoff interval with the largest F1; scores at least the cutoff count as toxic.

    Each row counts ``times``. Without toxic rows it lies above all scores, without clean ones below all.
    """
    order = np.argsort(-scores, kind="stable")
    s, y, n = scores[order], labels[order], np.ones(len(scores), int) if times is None else times[order]
    hits = np.cumsum(n * (y == 1))
    f1 = 2 * hits / (np.cumsum(n) + max(1, int((n * (y == 1)).sum())))
    ends = np.append(s[1:] < s[:-1], True)  # equal scores stay together
    below = np.append(s[1:], s[-1] - 2 if len(s) else 0)
    f1 = np.where(ends, f1, -1)
    if not len(s) or hits[-1] == 0:
        return float(s[0] + 1) if len(s) else 0.0
    tied = np.flatnonzero(f1 == f1.max())
    at = tied[np.argmax((s - below)[tied])]
    return float((s[at] + below[at]) / 2)


@dataclass
class Model:
    net: Net
    thresholds: dict[str | None, float]  # by language, of scores; None: of all, for languages that are not listed


def calibrated(net: Net, scores: np.ndarray, labels: np.ndarray, languages: list[str | None], times: np.ndarray | None = None) -> Model:
    """Move the net's offset so that the best cutoff of all calibration rows becomes THRESHOLD, and choose one per language."""
    times = np.ones(len(scores), int) if times is None else times
    shift = np.log(THRESHOLD / (1 - THRESHOLD))
    if len(set(labels.tolist())) == 2:
        cut = best_cutoff(scores, labels, times)
        net.offset[0] += shift - cut
        scores = scores + shift - cut
    thresholds: dict[str | None, float] = {None: THRESHOLD}
    for language in sorted({x for x in languages if x is not None}):
        own = np.array([x == language for x in languages])
        y = labels[own]
        if times[own][y == 1].sum() >= LEAST_TOXIC and (y == 0).any():
            thresholds[language] = float(1 / (1 + np.exp(-best_cutoff(scores[own], y, times[own]))))
    return Model(net, thresholds)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 12) -> Model:
    """A model from all labelled rows that aren't held out; ``lang`` is read for thresholds only."""
    for_training, kept, counts = learned(docs, labels, seed)
    net = train(for_training, counts, seed)
    rows = sorted(counted_scores(kept, net), key=lambda r: (r["lang"] or "", r["lang"] is None, r["toxic"], r["score"]))
    scores, y, times = np.array([r["score"] for r in rows], float), np.array([r["toxic"] for r in rows], int), np.array([r["times"] for r in rows], int)
    return calibrated(net, scores, y, [r["lang"] for r in rows], times)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``, the probability that a text is toxic; a column of that name is replaced.

    Null and empty texts and texts without words are scored as one window over nothing. Long texts
    are scored whole, in blocks. Equal texts get equal scores, an empty table stays empty, other
    columns come back as they are. Nothing is shuffled; the net has two megabytes.
    """
    base = docs.drop(name)
    schema = base.withColumn(name, F.lit(0.0)).schema
    net = model.net

    def run(batches):
        rows = table(net)
        for batch in batches:
            data, borders = flat_column(batch, "text")
            found = logits(net, rows, data, borders).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-found)))], [*batch.schema.names, name])

    return base.mapInArrow(run, schema)


def flagged(scored: DataFrame, model: Model, name: str = "flagged") -> DataFrame:
    """Rows with ``threshold``, that of their language, and ``name``: the score reaches it."""
    pairs = [x for k, v in sorted((k, v) for k, v in model.thresholds.items() if k is not None) for x in (F.lit(k), F.lit(v))]
    limit = F.lit(model.thresholds[None])
    if pairs:
        limit = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), limit)
    return scored.withColumn("threshold", limit).withColumn(name, F.col("score") >= F.col("threshold"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least THRESHOLD), threshold of the language and flagged, per row of ``docs``."""
    model = fit(docs, labels)
    named = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang", "text")
    return flagged(score(named, model), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "flagged")
