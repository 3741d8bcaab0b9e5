"""A byte-level convolutional network that scores the quality of whole texts.

Bytes are embedded; learned filters over 8 bytes run over the text in steps of 4. A chunk is 512
bytes, chunks overlap by half and cover the whole text. Each filter's largest response is taken per
chunk; over the chunks of a text their maximum and their mean are combined by one logistic unit.

Training runs on the driver, in numpy, on a sample of labelled rows that is bounded in rows and in
bytes per row; scoring runs in the tasks that read the texts, a bounded number of bytes at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_column, fold, pieces, release

STEP, WIDTH, DEPTH, FILTERS = 4, 8, 8, 32
HALF = 256  # bytes; a chunk is two halves
PAD = 256
BLOCK_HALVES = 2048  # halves whose responses are held at once
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1500, 1 << 15  # bound of the training sample
EPOCHS, BATCH, RATE, DECAY = 12, 64, 4e-3, 1e-4
THRESHOLD = 0.3


@dataclass
class Net:
    embedding: np.ndarray  # 257 x DEPTH, the last row stands for the space behind a text
    early: np.ndarray  # STEP * DEPTH x FILTERS, the first half of each filter
    late: np.ndarray  # the second half
    bias: np.ndarray
    unit: np.ndarray  # 2 * FILTERS: weights of the maxima and of the means
    offset: np.ndarray  # 1

    @classmethod
    def new(cls, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        scale = (2 / (WIDTH * DEPTH)) ** 0.5

        def normal(*shape: int) -> np.ndarray:
            return rng.standard_normal(shape).astype(np.float32)

        embedding = normal(257, DEPTH)
        embedding[PAD] = 0
        return cls(
            embedding, normal(STEP * DEPTH, FILTERS) * scale, normal(STEP * DEPTH, FILTERS) * scale, np.zeros(FILTERS, np.float32),
            normal(2 * FILTERS) * np.float32(0.1), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def halves(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of HALF bytes and the WIDTH - STEP behind them (numbers up to PAD), and the first row of each text."""
    sizes = np.diff(borders)
    rows = np.maximum(1, -(-sizes // HALF))
    first = np.concatenate([[0], np.cumsum(rows)])
    flat = np.full(int(first[-1]) * HALF + WIDTH - STEP, PAD, np.int16)
    where = np.arange(len(data)) + np.repeat(first[:-1] * HALF - borders[:-1], sizes)
    flat[where] = data
    view = np.lib.stride_tricks.sliding_window_view(flat, HALF + WIDTH - STEP)[::HALF].copy()
    view[first[1:] - 1, HALF:] = PAD  # not the next text's
    return view, first


def responses(net: Net, rows: np.ndarray) -> np.ndarray:
    """Responses of all filters at all steps: rows x steps x FILTERS, before the cut at zero."""
    steps = net.embedding[rows].reshape(len(rows), -1, STEP * DEPTH)
    out = steps[:, :-1] @ net.early
    out += steps[:, 1:] @ net.late
    return out


def chunk_maxima(best: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the halves' maxima those of chunks: a half and the next one of the same text, if there is one."""
    after = np.vstack([best[1:], best[-1:]])
    after[first[1:] - 1] = best[first[1:] - 1]
    return np.maximum(best, after)


def text_features(best: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum and mean over the chunks of each text. The last half alone counts as a chunk only if it is the first."""
    chunks = chunk_maxima(best, first)
    counts = np.diff(first)
    sums = np.add.reduceat(chunks, first[:-1], axis=0)
    last = chunks[first[1:] - 1]
    means = np.where((counts > 1)[:, None], (sums - last) / np.maximum(counts - 1, 1)[:, None], last)
    return np.hstack([np.maximum.reduceat(chunks, first[:-1], axis=0), means])


def scores(net: Net, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The probability of quality 1 of each text."""
    rows, first = halves(data, borders)
    best = np.empty((len(rows), FILTERS), np.float32)
    for a in range(0, len(rows), BLOCK_HALVES):
        best[a:a + BLOCK_HALVES] = responses(net, rows[a:a + BLOCK_HALVES]).max(axis=1)
    np.maximum(best + net.bias, 0, out=best)
    return 1 / (1 + np.exp(-(text_features(best, first) @ net.unit + net.offset[0]).astype(np.float64)))


def gradients(net: Net, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted log loss of a batch, and its derivative by each parameter."""
    raw = responses(net, rows)
    at = raw.argmax(axis=1)  # rows x FILTERS
    top = np.take_along_axis(raw, at[:, None], 1)[:, 0] + net.bias
    best = np.maximum(top, 0)
    features = text_features(best, first)
    p = 1 / (1 + np.exp(-(features @ net.unit + net.offset[0])))
    loss = -np.sum(weights * np.log(np.where(labels == 1, p, 1 - p) + 1e-7)) / weights.sum()
    d_logit = (weights * (p - labels) / weights.sum()).astype(np.float32)
    d_features = d_logit[:, None] * net.unit
    # back through the chunks of each text
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    chunks = chunk_maxima(best, first)
    chosen = chunks == features[text][:, :FILTERS]
    ties = np.add.reduceat(chosen, first[:-1], axis=0, dtype=np.float32)
    is_last = np.zeros(len(best), bool)
    is_last[first[1:] - 1] = True
    used = ~is_last | (counts[text] == 1)
    d_chunks = chosen * (d_features[:, :FILTERS] / ties)[text] + used[:, None] * (d_features[:, FILTERS:] / np.maximum(counts - 1, 1)[:, None])[text]
    after = np.vstack([best[1:], best[-1:]])
    later = (after > best) & ~is_last[:, None]
    d_best = d_chunks * ~later
    d_best[1:] += (d_chunks * later)[:-1]
    d_best = (d_best * (top > 0)).astype(np.float32)
    # back through the step at which each filter was largest
    steps = net.embedding[rows].reshape(len(rows), -1, STEP * DEPTH)
    d_early, d_late = np.empty_like(net.early), np.empty_like(net.late)
    d_steps = np.zeros_like(steps)
    which = np.arange(len(rows))
    for f in range(FILTERS):
        g = d_best[:, f]
        d_early[:, f], d_late[:, f] = g @ steps[which, at[:, f]], g @ steps[which, at[:, f] + 1]
        d_steps[which, at[:, f]] += g[:, None] * net.early[:, f]
        d_steps[which, at[:, f] + 1] += g[:, None] * net.late[:, f]
    hit = np.flatnonzero(np.abs(d_steps).sum(axis=2).ravel() > 0)
    spread = d_steps.reshape(-1, STEP, DEPTH)[hit].reshape(-1, DEPTH)
    numbers = rows.reshape(-1, STEP)[hit].ravel()
    d_embedding = np.stack([np.bincount(numbers, spread[:, d], 257) for d in range(DEPTH)], axis=1).astype(np.float32)
    d_embedding[PAD] = 0
    return float(loss), [d_embedding, d_early, d_late, d_best.sum(axis=0), d_logit @ features, d_logit.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Net:
    """Adam over batches in seeded order; without two classes the net gives every text its labels' share."""
    net = Net.new(seed)
    if len(set(labels.tolist())) < 2:
        net.unit[:] = 0
        net.offset[0] = 0 if not len(labels) else 4 if labels[0] else -4
        return net
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    done, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            some = order[a:a + BATCH]
            joined = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
            rows, first = halves(joined, np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])]))
            _, slopes = gradients(net, rows, first, labels[some], weights[some])
            done += 1
            rate = RATE * (1 - (done - 1) / total)
            for p, g, (m, v) in zip(net.parameters(), slopes, moments):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_bytes: int = SAMPLE_BYTES, folds: int = 5, seed: int = 5) -> Net:
    """A net from labelled rows that aren't held out (fold 0).

    The sample has at most ``per_class`` rows of each class, those with the smallest hash of their
    id, and of texts up to ``max_bytes`` only; whole texts are used. Weights give the classes the
    shares that they have among all labelled rows.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    text = F.coalesce(F.col("text"), F.lit(""))
    # the sample is drawn from ids and sizes; only then are its texts read
    rows = docs.select("doc_id", F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("hash")).where(fold("doc_id", folds) != 0).distinct().join(known, "doc_id")
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    drawn = []
    for quality in (0, 1):
        own = rows.where((F.col("quality") == quality) & (F.col("bytes") <= max_bytes))
        drawn += own.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "hash").limit(per_class).select("doc_id", "hash", "quality").collect()
    names = docs.sparkSession.createDataFrame(drawn, "doc_id bigint, hash bigint, quality int")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("hash", F.xxhash64("text")).join(
        F.broadcast(names), ["doc_id", "hash"])  # at most 2 * per_class rows
    sampled = sorted(texts.dropDuplicates(["doc_id", "hash"]).collect(), key=lambda r: (r["hash"], r["doc_id"]))
    y = np.array([r["quality"] for r in sampled], np.float32)
    taken = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    weights = np.array([counts[r["quality"]] / taken[r["quality"]] for r in sampled], np.float32)
    return train([r["text"].encode() for r in sampled], y, weights / max(weights.mean(), 1e-9) if len(weights) else weights, seed)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability that a text is of quality 1; columns of that name are replaced.

    Null and empty texts are scored as padding alone. Texts longer than a block are scored whole,
    block by block. Nothing is shuffled; the net has some kilobytes.
    """
    base = docs.drop("score")
    schema = base.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            data, borders = flat_column(batch, "text")
            out = [scores(net, data[borders[a]:borders[b]], borders[a:b + 1] - borders[a]) for a, b in pieces(np.diff(borders), 8 << 20)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names, "score"])
        release()

    return base.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    net = fit(docs, labels)
    named = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text")
    return score(named, net).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


