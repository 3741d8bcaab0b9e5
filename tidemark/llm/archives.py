"""Legacy web archives (ARC) and their conversion to WARC.

Files are written by Spark's text writer, one record a row and the records' own separator as the
line separator, so that a commit is atomic and a task that runs again leaves no half file. They
are read as whole binary files of bounded size and walked by the declared lengths only; nothing
is searched for inside contents.

ARC: each file begins with a version block that names the header fields of all later lines.
Version 1 has ``URL IP-address Archive-date Content-type Archive-length``; version 2 has
``Result-code Checksum Location Offset Filename`` in front of the length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import binary_column, column_like
from tidemark.session import scratch

# fixed by the formats
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRAWLED = b"20240101000000"

PARSED = (
    "kind string, file string, offset bigint, page_id bigint, url string, ip string, date string, mime string, "
    "http binary, payload binary, digest string, block_digest string, head_digest string, record_id string")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> bytes:
    """An address without blanks and control characters, as header lines need it; null or empty is ``-``."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode()) or b"-"


def http_response(payload: bytes, page_id: int | None) -> bytes:
    """The response headers in front of a page; the crawler notes its own page number there."""
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload)


def version_block(version: int, name: bytes, crawled: bytes = CRAWLED) -> bytes:
    body = b"%d 0 tidemark\n%s\n" % (version, FIELDS[version])
    if version == 1:
        return b"filedesc://%s 0.0.0.0 %s text/plain %d\n%s" % (name, crawled, len(body), body)
    return b"filedesc://%s 0.0.0.0 %s text/plain 200 - - 0 %s %d\n%s" % (name, crawled, name, len(body), body)


def arc_record(version: int, name: bytes, offset: int, url: bytes, body: bytes, crawled: bytes = CRAWLED) -> bytes:
    if version == 1:
        return b"%s 0.0.0.0 %s text/html %d\n%s" % (url, crawled, len(body), body)
    return b"%s 0.0.0.0 %s text/html 200 - - %d %s %d\n%s" % (url, crawled, offset, name, len(body), body)


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """One ARC file per partition of ``pages`` (page_id, url, html); partitions take the versions by turns.

    Null html is an empty page, a null url the address ``-``; other columns are ignored.
    """

    def records(batches):
        part = TaskContext.get().partitionId()
        version, name = versions[part % len(versions)], b"%06d.arc" % part
        block = version_block(version, name)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["value"])
        offset = len(block) + 1
        for batch in batches:
            out = []
            for page_id, url, html in zip(column_like(batch, "page_id").to_pylist(), column_like(batch, "url").to_pylist(), binary_column(batch, "html")):
                out.append(arc_record(version, name, offset, safe_url(url), http_response(html, page_id) + html))
                offset += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = pages.select("page_id", "url", "html").mapInArrow(records, "value binary")
    lines.select(F.col("value").cast("string")).write.option("compression", "gzip").text(path)


def read_lines(stream, where: str) -> Iterator[tuple[int, list[bytes], bytes]]:
    """(offset, fields of the header line, content) of each ARC record; the first must be a version block."""
    fields, at = 0, 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if line == b"\n":
            continue
        parts = line[:-1].split(b" ")
        if not fields:
            if not parts[0].startswith(b"filedesc://"):
                raise ValueError(f"{where}: no version block at the start")
        elif len(parts) != fields:
            raise ValueError(f"{where}: {len(parts)} fields in the header at {start}, {fields} wanted")
        length = int(parts[-1])
        content = stream.read(length)
        if len(content) != length:
            raise ValueError(f"{where}: the record at {start} ends early")
        at += length
        if not fields:
            version = int(content.split(b" ", 1)[0])
            named = content.split(b"\n")[1]
            if named != FIELDS.get(version):
                raise ValueError(f"{where}: version {version} with fields {named!r}")
            fields = len(named.split(b" "))
            if len(parts) != fields:
                raise ValueError(f"{where}: the version block's own header isn't of version {version}")
        yield start, parts, content


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Response headers with their empty line, and the payload; content without headers is all payload."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or end < 0:
        return b"", content
    return content[:end + 4], content[end + 4:]


def header_value(headers: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", headers)
    return found[1].decode("utf-8", "replace") if found else None


def iso_date(date: bytes) -> str:
    """14 digits as a WARC date; missing digits are the smallest that fit."""
    d = date.decode() + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record(name: str, start: int, parts: list[bytes], content: bytes) -> tuple:
    url, ip, date, mime = (p.decode("utf-8", "replace") for p in parts[:4])
    first = parts[0].startswith(b"filedesc://")
    http, payload = (b"", content) if first else split_http(content)
    page = header_value(http, b"X-Page-Id")
    digest = base32_sha1(payload)
    identity = f"{url} {date} {digest} {name} {start}"
    return (
        "warcinfo" if first else "response", name, start, int(page) if page else None, None if url == "-" else url, ip, iso_date(parts[2]),
        mime, http, payload, digest, base32_sha1(content), base32_sha1(http), f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identity)}>")


def _walk(files: DataFrame, walk, schema: str) -> DataFrame:
    """Rows that ``walk(name, stream)`` makes of each file, sent on in batches of some MB."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                stream = gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))
                held, size = [], 0
                for row in walk(path.rsplit("/", 1)[-1], stream):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, bytes)) + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], arrow)

    return files.select("path", "content").mapInArrow(rows, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files below ``path`` with what WARC needs: ids, dates, types and digests."""

    def walk(name, stream):
        for start, parts, content in read_lines(stream, name):
            yield _record(name, start, parts, content)

    return _walk(spark.read.format("binaryFile").load(path), walk, PARSED)


def mark_revisits(records: DataFrame) -> DataFrame:
    """Of records with equal payloads the one with the largest page_id (then file and offset) stays a response.

    The groups' heads come from a partial aggregation over digests; only digests that occur twice
    are joined back, so a payload that many records share is one row on that side.
    """
    heads = records.where("kind = 'response'").groupBy("digest").agg(
        F.max(F.struct("page_id", "file", "offset", "record_id", "url", "date")).alias("head"), F.count("*").alias("n")
    ).where("n > 1").select("digest", "head")
    joined = records.join(heads, "digest", "left")
    own = (F.col("head.file") == F.col("file")) & (F.col("head.offset") == F.col("offset"))
    again = (F.col("kind") == "response") & F.col("head").isNotNull() & ~own
    return joined.withColumn("kind", F.when(again, "revisit").otherwise(F.col("kind")))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def warc_record() -> Column:
    """The whole record but for the two line ends behind it, as one string column."""
    kind = F.col("kind")
    revisit = kind == "revisit"
    head = F.col("http").cast("string")
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload").cast("string")))
    info = kind == "warcinfo"
    return F.concat(
        F.lit("WARC/1.0\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", F.col("record_id")), _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.when(~info, F.col("url"))), _line("WARC-IP-Address", F.when(~info, F.col("ip"))),
        _line("WARC-Payload-Digest", F.when(~info, F.concat(F.lit("sha1:"), F.col("digest")))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("head_digest")).otherwise(F.col("block_digest")))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, F.col("head.record_id"))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("head.url"))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.col("head.date"))),
        _line("WARC-Filename", F.when(info, F.col("file"))),
        F.lit("Content-Type: "), F.when(info, F.col("mime")).otherwise("application/http; msgtype=response"),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_warc(records: DataFrame, path: str) -> None:
    records.select(warc_record().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def walk_warc(stream, where: str) -> Iterator[tuple[bytes, bytes]]:
    """(headers, block) of each WARC record, by the declared lengths."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if line != b"WARC/1.0\r\n":
            raise ValueError(f"{where}: {line[:40]!r} where a record should begin")
        headers = []
        while (line := stream.readline()) not in (b"\r\n", b""):
            headers.append(line)
        head = b"".join(headers)
        length = int(header_value(head, b"Content-Length"))
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{where}: a record ends early")
        yield head, block


READ = (
    "record_type string, record_id string, page_id bigint, url string, date string, refers_id string, payload_bytes bigint, "
    "payload_digest string, payload binary")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records below ``path``; a revisit has the length and digest of the payload it refers to.

    Block and payload digests of what is stored are computed again and must agree with the headers.
    Without ``payloads`` the payloads are read and checked, but not returned.
    """

    def walk(name, stream):
        for head, block in walk_warc(stream, name):
            kind = header_value(head, b"WARC-Type")
            if header_value(head, b"WARC-Block-Digest") != f"sha1:{base32_sha1(block)}":
                raise ValueError(f"{name}: a block doesn't have the digest of its header")
            if kind not in ("response", "revisit"):
                continue
            http, payload = split_http(block)
            digest = header_value(head, b"WARC-Payload-Digest").removeprefix("sha1:")
            if kind == "response" and digest != base32_sha1(payload):
                raise ValueError(f"{name}: a payload doesn't have the digest of its header")
            page, length = header_value(http, b"X-Page-Id"), header_value(http, b"Content-Length")
            row = (
                kind, header_value(head, b"WARC-Record-ID"), int(page) if page else None, header_value(head, b"WARC-Target-URI"),
                header_value(head, b"WARC-Date"), header_value(head, b"WARC-Refers-To"), int(length) if length else len(payload), digest,
                payload if kind == "response" else None)
            yield row if payloads else row[:-1]

    return _walk(spark.read.format("binaryFile").load(path), walk, READ if payloads else READ.removesuffix(", payload binary"))


def convert(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages through ARC files into WARC files and back: one row per page as the WARC files have it, ``payloads`` with its payload.

    ``pages`` has page_id, url and html; more columns are ignored, an empty table gives no rows.
    Repeated rows are records of their own (of equal ones one is the response). A null html is an
    empty payload, a null page_id stays null and counts as the smallest, a null url is left out.
    """
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc)
    write_warc(mark_revisits(read_arc(spark, arc)), warc)
    return read_warc(spark, warc, payloads)


def resolved(records: DataFrame) -> DataFrame:
    """Adds ``refers_to``, the page of the response that a revisit names."""
    named = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return records.join(named, "refers_id", "left")
