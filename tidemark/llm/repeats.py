"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Suffixes are ordered only through their first 200 bytes (a window), so equal groups at the end are
exactly the repeated windows. Groups of one are dropped after each pass, which is what keeps the
passes small.

* First digit: of the 153 strings of 48 bytes inside a window the one with the smallest hash (the
  leftmost of equals). It depends on the window's bytes alone, so equal windows have equal digits.
  Neighbouring windows mostly share theirs at the same place; such a run of windows is one row.
* Second digit: the bytes of the whole run. Runs whose bytes occur twice are repeated throughout,
  runs alone with their first digit hold no repeated window. Only counts and extremes per digit are
  gathered, so a digit may have any number of rows.
* Last digits: of the remaining runs, one per distinct content, the windows with equal first digits
  are sorted by 40 bytes at a time in the task that holds the digit, and neighbours compared byte by
  byte. Digits with very many distinct runs are cut up by windows instead, see ``_spread``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column_like, flat_column, packed, pieces
from tidemark.session import stored

WINDOW, GRAM = 200, 48
REACH = WINDOW - GRAM + 1
PIECE = 1 << 20  # bytes of texts that are hashed at once
POSITION_BITS = 22
DIGIT = 40
GROUP_RUNS = 4096  # a first digit with more distinct runs is cut up by windows

_ODD = np.random.default_rng(41).integers(0, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _ODD[30]
    h ^= h >> np.uint64(29)
    return h


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; the last 7 places have none."""
    return np.lib.stride_tricks.as_strided(data.view(np.uint8), (max(0, len(data) - 7), 8), (1, 1)).copy().view("<u8").ravel()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 48 bytes from each place on."""
    words, n = _words(data), len(data) - GRAM + 1
    h = words[:n] * _ODD[0]
    for j in range(1, GRAM // 8):
        h += words[8 * j:8 * j + n] * _ODD[j]
    return _mixed(h)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, from running minima of blocks both ways."""
    n = len(values) - width + 1
    padded = np.full((len(values) + 2 * width) // width * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def runs(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one first digit: (text, start, windows, the digit, where it lies from start).

    ``data`` holds texts one after another, below 2**22 bytes in all; no window crosses a border.
    """
    if len(data) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    grams = gram_hashes(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    marked = smallest((grams & ~low) | np.arange(len(grams), dtype=np.uint64), REACH)
    place = (marked & low).astype(np.int64)
    valid = np.ones(len(place) + 1, bool)
    valid[-1] = False
    ends = borders[1:]
    for a, b in zip(np.maximum(borders[:-1], ends - WINDOW + 1).tolist(), ends.tolist()):
        valid[a:b] = False
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | ~valid[:-2]
    starts = np.flatnonzero(change & valid[:-1])
    stops = np.flatnonzero(valid[:-1] & (np.concatenate([change[1:], [True]]) | ~valid[1:])) + 1
    where = np.searchsorted(borders, starts, side="right") - 1
    return where, starts, stops - starts, grams[place[starts]], place[starts] - starts


def cut(docs: DataFrame) -> DataFrame:
    """(key, whole, doc, text_hash, at) of each run in ``doc``, ``text_hash``, ``text``.

    ``at`` packs the run's start, its windows and its digit's place (12 bits each).
    """

    def run(batches):
        for batch in batches:
            doc, text_hash = (column_like(batch, c).to_numpy(zero_copy_only=False) for c in ("doc", "text_hash"))
            data, borders = flat_column(batch, "text")
            for a, b in pieces(np.diff(borders), PIECE):
                for shift, part, inner in _parts(data[borders[a]:borders[b]], borders[a:b + 1] - borders[a]):
                    text, start, windows, digit, off = runs(part, inner)
                    view = memoryview(part.tobytes())
                    whole = np.fromiter((xxhash.xxh3_64_intdigest(view[s:s + w]) for s, w in zip(start.tolist(), (windows + WINDOW - 1).tolist())), np.uint64, len(start))
                    at = (start - inner[text] + shift) << 24 | windows << 12 | off
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digit.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc[a + text]), pa.array(text_hash[a + text]), pa.array(at)],
                        ["key", "whole", "doc", "text_hash", "at"])

    return docs.mapInArrow(run, "key bigint, whole bigint, doc bigint, text_hash bigint, at bigint")


def _parts(data: np.ndarray, borders: np.ndarray):
    """Texts as they are; one that is too long for its places to be numbered comes in overlapping parts."""
    most = (1 << POSITION_BITS) - 1
    if len(data) <= most:
        yield 0, data, borders
        return
    for start in range(0, len(data) - WINDOW + 1, most - WINDOW + 1):
        part = data[start:start + most]
        yield start, part, np.array([0, len(part)])


def sort_windows(contents: list[bytes], group: np.ndarray, windows: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """For each content which of its windows occur in another content of its group.

    Equal windows have their first digit at the same place of the window, so group and place are
    the digit already sorted by; then 40 bytes at a time.
    """
    data = np.frombuffer(b"".join(contents) + bytes(8), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contents])[:-1]])
    content = np.repeat(np.arange(len(contents)), windows)
    inner = np.arange(len(content)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[content] + inner
    name = group[content] * 4096 + (places[content] - inner)
    words = _words(data)
    alive = np.arange(len(at))
    order = np.argsort(name, kind="stable")
    for depth in range(0, WINDOW + DIGIT, DIGIT):
        same = name[order][1:] == name[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        fresh = np.concatenate([[True], ~same])
        number = np.cumsum(fresh)[twice]
        alive = alive[order[twice]]
        if depth == WINDOW or not len(alive):
            break
        digit = words[at[alive] + depth] * _ODD[6]
        for j in range(1, DIGIT // 8):
            digit += words[at[alive] + depth + 8 * j] * _ODD[6 + j]
        digit = _mixed(digit)
        order = np.lexsort((digit, number))
        name = np.empty(len(alive), np.int64)
        step = (np.diff(number[order]) != 0) | (np.diff(digit[order]) != 0)
        name[order] = np.concatenate([[0], np.cumsum(step)])
    repeated = np.zeros(len(at), bool)
    if len(alive):  # neighbours of a group are compared in full
        pair = np.flatnonzero(number[1:] == number[:-1])
        equal = np.ones(len(pair), bool)
        for j in range(0, WINDOW, 8):
            equal &= words[at[alive[pair]] + j] == words[at[alive[pair + 1]] + j]
        repeated[alive[pair[equal]]] = True
        repeated[alive[pair[equal] + 1]] = True
    return np.split(repeated, np.cumsum(windows)[:-1])


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    borders = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
    return list(zip(borders[::2].tolist(), borders[1::2].tolist()))


SPANS = "doc bigint, text_hash bigint, start bigint, stop bigint"


def _sorted_spans(fetched: DataFrame) -> DataFrame:
    """Spans of the runs whose windows recur under the same key, a key's runs in one task."""
    limit = 1 << 20

    def run(batches):
        held, size, last = [], 0, None

        def sort():
            keys = np.array([h[0] for h in held])
            group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
            at = np.array([h[3] for h in held], np.int64)
            found = sort_windows([h[4] for h in held], group, at >> 12 & 4095, at & 4095)
            rows = [(h[1], h[2], (h[3] >> 24) + a, (h[3] >> 24) + b + WINDOW - 1) for h, flags in zip(held, found) for a, b in _ranges(flags)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc", "text_hash", "start", "stop"])

        for batch in batches:
            for row in zip(*(column_like(batch, c).to_pylist() for c in ("key", "doc", "text_hash", "at", "bytes"))):
                if size > limit and row[0] != last:
                    yield sort()
                    held, size = [], 0
                held.append(row)
                size += row[3] >> 12 & 4095
                last = row[0]
        if held:
            yield sort()

    return fetched.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def _spread(fetched: DataFrame) -> DataFrame:
    """The same for keys with very many runs: each window is its own row, and windows are counted by their digest."""
    start, windows = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(F.lit(4095))
    each = fetched.withColumn("i", F.explode(F.sequence(F.lit(0), (windows - 1).cast("int")))).withColumn("w", F.md5(F.expr(f"substring(bytes, i + 1, {WINDOW})")))
    twice = each.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return each.join(twice, "w").select("doc", "text_hash", (start + F.col("i")).alias("start"), (start + F.col("i") + WINDOW).alias("stop"))


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of ``wanted`` runs (doc, text_hash, at, key), cut out of their texts."""
    asked = wanted.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("key", "at", "many")).alias("asked"))  # as many as the text has
    joined = packed(docs).join(asked, ["doc", "text_hash"])

    def run(batches):
        out = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, text_hash, z, asked in zip(*(column_like(batch, c).to_pylist() for c in ("doc", "text_hash", "z", "asked"))):
                text = out.decompress(z)
                at = [a["at"] for a in asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a["key"] for a in asked], pa.int64()), pa.array([doc] * len(at), pa.int64()), pa.array([text_hash] * len(at), pa.int64()),
                     pa.array(at, pa.int64()), pa.array([a["many"] for a in asked]),
                     pa.array([text[p >> 24:(p >> 24) + (p >> 12 & 4095) + WINDOW - 1] for p in at], pa.binary())],
                    ["key", "doc", "text_hash", "at", "many", "bytes"])

    return joined.mapInArrow(run, "key bigint, doc bigint, text_hash bigint, at bigint, many boolean, bytes binary")


def repeated_spans(docs: DataFrame, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Spans (doc, text_hash, start, stop) whose windows all start somewhere else too; they may overlap."""
    rows = cut(docs)
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most")).where("n > 1")
    shared = stored(rows.join(counts, "key").select("key", "whole", "doc", "text_hash", "at", (F.col("least") != F.col("most")).alias("several")), "runs")
    start, windows = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(F.lit(4095))
    full = [F.col("doc"), F.col("text_hash"), start.alias("start"), (start + windows + (WINDOW - 1)).alias("stop")]
    several = shared.where("several")
    contents = stored(several.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc", "text_hash", "at")).alias("one")), "contents")
    copied = several.join(contents.where("n > 1").select("key", "whole"), ["key", "whole"], "left_semi")
    sizes = contents.groupBy("key").agg((F.count("*") > group_runs).alias("many"))
    fetched = stored(_fetched(docs, contents.join(sizes, "key").select("key", "many", "one.doc", "one.text_hash", "one.at")), "windows")
    spans = shared.where("not several").select(*full).union(copied.select(*full)).union(_sorted_spans(fetched.where("not many"))).union(_spread(fetched.where("many")))
    return stored(spans, "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (merged, removed), kept (the remaining bytes) of each document.

    Every byte that a 200-byte string covers which also starts anywhere else, in the same or
    another document, is removed; strings are judged on the input. Null texts are empty, texts
    below 200 bytes stay whole, repeated rows are copies of each other. Other columns are ignored;
    an empty table gives no rows. Documents are told apart by id and text hash, so equal ids with
    different texts are no trouble; a null id is fine.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    own = base.drop("doc_id")
    spans = repeated_spans(own).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # as many as the text has
    joined = packed(base).join(spans, ["doc", "text_hash"], "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        out = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, sizes, merged, kept = column_like(batch, "doc_id"), [], [], []
            for z, spans in zip(column_like(batch, "z").to_pylist(), column_like(batch, "spans").to_pylist()):
                text, own = out.decompress(z), []
                for s in sorted((s["start"], s["stop"]) for s in spans or []):
                    if own and s[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], s[1])
                    else:
                        own.append([*s])
                borders = [0, *(x for s in own for x in s), len(text)]
                sizes.append(len(text))
                merged.append([{"start": a, "stop": b} for a, b in own])
                kept.append(b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("doc_id", "z", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
