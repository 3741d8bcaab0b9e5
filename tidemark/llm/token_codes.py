"""Token ids as directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of all ids that
have one, a bitmap that says whether another chunk follows, and a directory of the bitmap's ones
before each 64-bit word. The i-th id of level k continues at place rank(i) of level k + 1, so any
id is read alone, without decoding a block.

A file is a sequence of segments, each with its own header, index of documents and levels (see
``encode_segment``). Files are written by Spark's text writer, whose commits are atomic.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Bits, column_like, pieces, release
from tidemark.session import scratch, shuffle_partitions, small_batches, stored

MAGIC = b"DAC1"
SEGMENT_TOKENS = 1 << 20
CACHED_PIECES = 250_000  # of each Python worker
PIECE = 1 << 20  # bytes of texts that are encoded at once
LATIN = 0x130  # characters below are in normal form C, and so are their lower cases
# fixed by the tokenizer file: how it cuts texts into pieces
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# ---- the code --------------------------------------------------------------------------------


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, Bits]]:
    """Chunks and continuation bitmap of each level; an id of 0 has one chunk."""
    levels, rest = [], ids.astype(np.uint64)
    while len(rest):
        more = rest >> np.uint64(8) > 0
        levels.append(((rest & np.uint64(255)).astype(np.uint8), Bits.of(more)))
        rest = rest[more] >> np.uint64(8)
    return levels


def access(levels: list[tuple[np.ndarray, Bits]], at: np.ndarray) -> np.ndarray:
    """The ids at any places, each read by its own chunks and ranks."""
    out = np.zeros(len(at), np.uint64)
    here, place = np.arange(len(at)), at.astype(np.int64)
    for k, (chunks, more) in enumerate(levels):
        out[here] |= chunks[place].astype(np.uint64) << np.uint64(8 * k)
        on = more.get(place)
        here, place = here[on], more.rank(place[on])
        if not len(here):
            break
    return out


def encode_segment(documents: list[tuple[int | None, np.ndarray]]) -> bytes:
    """Magic; numbers of documents, ids and levels; ids of documents, null marks, lengths; the levels.

    Each level: its number of chunks, the chunks, the bitmap's words, the directory. Little-endian.
    """
    ids = np.concatenate([d[1] for d in documents]) if documents else np.zeros(0, np.uint32)
    levels = encode_levels(ids)
    parts = [
        MAGIC, struct.pack("<QQQ", len(documents), len(ids), len(levels)), np.array([d[0] or 0 for d in documents], "<i8").tobytes(),
        np.array([d[0] is None for d in documents], np.uint8).tobytes(), np.array([len(d[1]) for d in documents], "<u8").tobytes()]
    for chunks, more in levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), more.words.tobytes(), more.before.tobytes()]
    return b"".join(parts)


class Segment:
    """A segment's index of documents and its levels, as views of the file's bytes."""

    def __init__(self, data: memoryview):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        documents, self.n_ids, n_levels = struct.unpack("<QQQ", data[4:28])
        self.end = 28

        def take(kind: str, n: int) -> np.ndarray:
            kind = np.dtype(kind)
            got = np.frombuffer(data, kind, n, self.end)
            self.end += n * kind.itemsize
            return got

        self.doc_ids, self.nulls, self.lengths = take("<i8", documents), take("u1", documents) != 0, take("<u8", documents).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), Bits(take("<u8", n // 64 + 1), take("<u4", n // 64 + 1))))

    def ids(self, at: np.ndarray) -> np.ndarray:
        return access(self.levels, at)


def segments(data: bytes) -> Iterator[Segment]:
    """The segments of a file; each ends with a line end."""
    view, at = memoryview(data), 0
    while at < len(view):
        segment = Segment(view[at:])
        yield segment
        at += segment.end + 1


# ---- encoding of texts -----------------------------------------------------------------------


def _class(wanted) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN) if wanted(unicodedata.category(chr(c)), chr(c)))


class _Numbers(dict):
    """Numbers strings as they are looked up, and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Ids of texts as the tokenizer file gives them, with the work done once per distinct piece.

    Texts of characters below ``LATIN`` are their own normal form but for case, so they are put
    into lower case and cut here by the file's own pattern, its classes written out for these
    characters; the tokenizer's model encodes each new piece once per worker. All other texts, and
    those with a special token's name in them, go through the tokenizer as they are. A file with
    another normalizer or pattern gets no such shortcut. Both ways give the same ids.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        told = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and bool(cuts) and cuts[0].get("pattern") == {"Regex": PATTERN}
        letter, number = _class(lambda k, c: k[0] == "L"), _class(lambda k, c: k[0] == "N")
        blank = _class(lambda k, c: c.isspace() and c not in "\x1c\x1d\x1e\x1f")
        # the alternatives of PATTERN begin with different characters but for the apostrophe, so runs of letters may come first
        self.find = re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{blank}{letter}{number}]+").findall
        self.other = re.compile(f"[^\0-{chr(LATIN - 1)}]").search
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(LATIN)}
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbers()
        self.lengths, self.flat = array("q"), array("I")

    def _learn(self) -> None:
        """Ids of the pieces that were numbered since the last call."""
        model, new = self.tokenizer.model, self.number.new
        for piece in new:
            ids = [t.id for t in model.tokenize(piece.translate(self.spelled))]
            self.lengths.append(len(ids))
            self.flat.extend(ids)
        new.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > self.cached:
            self._clear()
        plain = [self.known and not self.other(t) and not any(s in t for s in self.special) for t in texts]
        get = self.number.__getitem__
        found = [np.fromiter(map(get, self.find(t.lower())), np.int64) if p else None for t, p in zip(texts, plain)]
        self._learn()
        lengths, flat = np.frombuffer(self.lengths, np.int64), np.frombuffer(self.flat, np.uint32)
        first, out = np.cumsum(lengths) - lengths, []
        for numbers, text in zip(found, texts):
            if numbers is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            each = lengths[numbers]
            ends = np.cumsum(each)
            out.append(flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[numbers] - ends + each, each)])
        del lengths, flat
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file; workers serve many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- jobs ------------------------------------------------------------------------------------


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, bucket, ids) of each document: ids as 32-bit numbers, the end id last; buckets ascend with doc_id.

    Bucket borders come from the ids alone, so texts are encoded once and never sampled. Null ids
    come first. Ids are sent as 16-bit numbers where all of a document's fit.
    """
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    found = docs.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    borders = np.array(found or [], np.int64)

    def encode(batches):
        own = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids, texts = column_like(batch, "doc_id"), column_like(batch, "text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for start, stop in pieces(sizes, PIECE):
                ids = [np.concatenate([x, end]) for x in own.encode([t or "" for t in texts.slice(start, stop - start).to_pylist()])]
                some = doc_ids.slice(start, stop - start).to_pylist()
                places = [0 if d is None else int(np.searchsorted(borders, d, side="right")) for d in some]
                wide = [bool(x.max() > 65535) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array(places, pa.int32()), pa.array(wide), pa.array([x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide)], pa.binary())],
                    ["doc_id", "bucket", "wide", "ids"])
        release()

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, bucket int, wide boolean, ids binary")


def write_codes(ids: DataFrame, path: str, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """A folder of files per bucket, documents in ascending order of doc_id inside; equal ids stay in order of their tokens."""
    sorted_ = ids.repartition(shuffle_partitions(ids.sparkSession), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")

    def pack(batches: Iterable[pa.RecordBatch]):
        held, size, bucket = [], 0, None

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([encode_segment(held)], pa.binary())], ["bucket", "value"])

        for batch in batches:
            columns = [column_like(batch, c) for c in ("doc_id", "bucket", "wide", "ids")]
            for row in range(batch.num_rows):
                doc_id, place, wide, data = (c[row].as_py() for c in columns)
                if held and (place != bucket or size > segment_tokens):
                    yield packed()
                    held, size = [], 0
                bucket = place
                held.append((doc_id, np.frombuffer(data, "<u4" if wide else "<u2")))
                size += len(held[-1][1])
        if held:
            yield packed()
        held = []
        release()

    segments_ = sorted_.mapInArrow(pack, "bucket int, value binary")
    segments_.select("bucket", F.col("value").cast("string")).write.partitionBy("bucket").text(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, doc_id, start, n_tokens, ids_crc32) of each document in the files below ``path``, starts counted over all files.

    Every id is fetched from the codes by its place. One row per file holds its number of ids; those are summed up for the files before.
    """
    schema = "bucket int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"

    def read(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                before = 0
                for s in segments(content.as_py()):
                    ids = s.ids(np.arange(s.n_ids)).astype("<u4")
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(s.starts[:-1].tolist(), s.starts[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([where] * len(sums), pa.int32()), pa.array(s.doc_ids, pa.int64(), mask=s.nulls), pa.array(before + s.starts[:-1]),
                         pa.array(s.lengths), pa.array(sums, pa.int64())], ["bucket", "doc_id", "local", "n_tokens", "ids_crc32"])
                    before += s.n_ids
        release()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("bucket").cast("int"), "content")
    rows = stored(files.mapInArrow(read, schema), "codes")
    totals = rows.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(offsets, "bucket").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode whole texts, write the code files in ascending order of doc_id, read them back.

    ``docs`` has doc_id and text, more columns are ignored; a null or empty text is the end id
    alone; null doc_ids come first; repeated ids follow each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch(spark, "token-codes")
    ids = encoded(docs, tokenizer, end_id)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    with small_batches(spark):
        write_codes(ids, path)
        return read_codes(spark, path)
