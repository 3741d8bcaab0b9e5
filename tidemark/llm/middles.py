"""Fill-in-middle: cut a text at two places and put the middle behind the rest.

A rolling hash over the bytes of a text cuts it into chunks at places that the content decides, so
equal passages of many texts become equal chunks. What a chunk adds to a text is summarised once:
its code points, whether it holds a sentinel, and its first and last bytes, which show a sentinel
that two chunks share. Summaries are kept in a cache of bounded size and are used again only for a
chunk of the same bytes. Cuts are found by adding up the chunks' counts and looking into the one
chunk in which a cut lies.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column_like, flat_column

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
EDGE = 2  # bytes of a sentinel that may lie in the next chunk
WINDOW = 16  # bytes that decide about a border
MEAN_BITS, LARGEST = 10, 1 << 13  # a border every 1 KiB or so, and after 8 KiB at the latest
CACHE_BYTES = 32 << 20
BLOCK = 4 << 20  # bytes whose rolling hashes are held at once
TRANSFORMED, SUFFIX_FIRST = 90, 20  # percent

_GEAR = np.random.default_rng(1309).integers(0, 2**32, 256, dtype=np.uint32)


def candidates(data: np.ndarray, bits: int = MEAN_BITS) -> np.ndarray:
    """Positions behind which the rolling hash of the last WINDOW bytes asks for a border; sorted.

    The hash of a window is the sum of its bytes' random numbers, each shifted by its distance from
    the end; windows of 2, 4, 8 and 16 bytes are made from two halves. Data is read in blocks.
    """
    found = []
    for start in range(0, len(data), BLOCK):
        before = max(0, start - WINDOW + 1)
        h = _GEAR[data[before:start + BLOCK]]
        width = 1
        while width < WINDOW:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
            width *= 2
        # the upper bits depend on the most bytes; 16 shifts leave the oldest byte its lower 16 bits
        hits = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + before + 1
        found.append(hits[hits > start])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(borders: np.ndarray, start: int, end: int, largest: int = LARGEST) -> Iterator[tuple[int, int]]:
    """The chunks of the text at ``start`` to ``end``, given the candidates of all texts.

    A window that reaches into the text before does not count, and a chunk has ``largest`` bytes at most.
    """
    a = start
    for b in borders[np.searchsorted(borders, start + WINDOW):np.searchsorted(borders, end)].tolist() + [end]:
        while b - a > largest:
            yield a, a + largest
            a += largest
        if b > a:
            yield a, b
            a = b


@dataclass(frozen=True, slots=True)
class Summary:
    units: int  # code points that start in the chunk
    sentinel: bool
    head: bytes
    tail: bytes


def summarise(chunk: bytes) -> Summary:
    starts = len(chunk) if chunk.isascii() else int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))
    sentinel = any(s in chunk for s in (PREFIX, SUFFIX, MIDDLE))
    return Summary(starts, sentinel, chunk[:EDGE], chunk[-EDGE:])


class Cache:
    """Summaries by content hash; one is used only if the stored bytes are those of the chunk. The oldest chunks go first."""

    def __init__(self, max_bytes: int = CACHE_BYTES, digest=hash):
        self.max_bytes, self.digest, self.size, self.hits = max_bytes, digest, 0, 0
        self.known: OrderedDict[int, tuple[bytes, Summary]] = OrderedDict()

    def summary(self, chunk: bytes) -> Summary:
        key = self.digest(chunk)
        stored = self.known.get(key)
        if stored is not None and stored[0] == chunk:
            self.hits += 1
            return stored[1]
        made = summarise(chunk)
        if stored is None:  # another chunk of the same hash keeps its place
            self.known[key] = chunk, made
            self.size += len(chunk)
            while self.size > self.max_bytes:
                self.size -= len(self.known.popitem(last=False)[1][0])
        return made


def offset_in(chunk: bytes, unit: int) -> int:
    """The byte at which code point ``unit`` of those that start in the chunk begins."""
    if chunk.isascii():
        return unit
    return int(np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)[unit])


class Text:
    """A text as its chunks' summaries: code points, sentinels, and the byte at which any code point starts."""

    def __init__(self, text: bytes, parts: list[tuple[int, int]], cache: Cache):
        self.text, self.parts, self.upto = text, parts, [0]
        self.sentinel, tail = False, b""
        for a, b in parts:
            s = cache.summary(text[a:b])
            self.upto.append(self.upto[-1] + s.units)
            seam = tail + s.head
            self.sentinel |= s.sentinel or any(x in seam for x in (PREFIX, SUFFIX, MIDDLE))
            tail = (tail + s.tail)[-EDGE:] if b - a < EDGE else s.tail
        self.units = self.upto[-1]

    def byte(self, unit: int) -> int:
        if unit >= self.units:
            return len(self.text)
        k = bisect_right(self.upto, unit) - 1
        a, b = self.parts[k]
        return a + offset_in(self.text[a:b], unit - self.upto[k])


def cut(doc_id: str, text: Text, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and the output of one text, by four numbers from a digest of its id."""
    digest = hashlib.sha256(b"1:" + doc_id.encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))
    if not text.units or text.sentinel or h3 % 100 >= transformed:
        return "plain", None, None, text.text
    a, b = sorted((h1 % (text.units + 1), h2 % (text.units + 1)))
    at, to = text.byte(a), text.byte(b)
    prefix, middle, suffix = text.text[:at], text.text[at:to], text.text[to:]
    if h4 % 100 < suffix_first:
        return "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def transform(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (code points), form, prefix_chars, middle_chars, output.

    A text that is empty or holds a sentinel stays plain, as do those whose id says so. A null text
    counts as empty, a null id as an empty one. Rows of one id and text give equal rows, and other
    columns are left out. Texts of any length are cut as a whole; besides the batch a task holds one
    text's output and the cache. An empty table gives none. Nothing is shuffled.
    """
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        cache = Cache()
        for batch in batches:
            data, edges = flat_column(batch, "text")
            borders, raw, ids = candidates(data), data.tobytes(), column_like(batch, "id").to_pylist()
            rows = []
            for doc_id, a, b in zip(ids, edges[:-1].tolist(), edges[1:].tolist()):
                text = Text(raw[a:b], [(x - a, y - a) for x, y in chunks(borders, a, b)], cache)
                rows.append((text.units, *cut(doc_id, text, transformed, suffix_first)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([
                column_like(batch, "doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary()).cast(pa.string()),
            ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return named.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from, by the sentinels in it."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output))


def report(docs: DataFrame) -> DataFrame:
    """The transformation with digests of the output and of the text that is rebuilt from it."""
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"))


# Code points of the text are those that SQL's length and substr count.
REPORT_SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
    SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
        CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM hashed
), forms AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
        WHEN 'spm' THEN '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM forms
"""
