"""WARC archives compressed with Zstandard: writer and reader.

An archive begins with a skippable frame that holds the dictionary; each record is one frame compressed with it. The reader
loads the dictionary, decodes a frame at a time from a stream and checks every record's version line, required headers,
Content-Length against what the frame holds, the record's end, the HTTP head's own Content-Length, and the payload digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, table

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Payloads below this many bytes are stored again instead of being referred to.
LEAST_REVISIT = 100


@dataclass(frozen=True)
class WarcParams:
    level: int = 3
    dictionary_bytes: int = 16 << 10
    #: The dictionary of an archive is trained on its first records, up to this many bytes.
    sample_bytes: int = 1 << 20
    #: A new archive begins when one has taken this many uncompressed bytes.
    archive_bytes: int = 128 << 20
    #: The reader refuses larger records if a limit is given. None takes whatever one value of a table can hold.
    max_record: int | None = None
    date: str = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters and percent signs are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in value).strip() or "about:blank"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without the payload if refers_to names the page that has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url or ""))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def info_record(date: str) -> bytes:
    block = b"software: streetloom\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return VERSION + head.encode() + block + END


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained on samples, or their own beginning where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


class ArchiveWriter:
    def __init__(self, out: BinaryIO, samples: list[bytes], p: WarcParams):
        raw = dictionary(samples, p.dictionary_bytes)
        packed = zstandard.ZstdCompressor(level=p.level).compress(raw)
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=p.level, dict_data=zstandard.ZstdCompressionDict(raw))
        self.records = self.bytes = 0
        self.add(info_record(p.date))

    def add(self, record: bytes) -> None:
        self.out.write(self.zstd.compress(record))
        self.records += 1
        self.bytes += len(record)


def read_frames(stream: BinaryIO, p: WarcParams = WarcParams(), chunk: int = 1 << 16) -> Iterator[bytes]:
    """The content of each frame of an archive, one after the other; memory holds one record and one chunk."""
    buf = stream.read(8)
    if len(buf) < 8:
        raise WarcError("the archive ends before its first frame")
    magic, size = struct.unpack("<II", buf)
    data = None
    if magic == DICTIONARY_MAGIC:
        raw = stream.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary frame is cut off")
        raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw
        data, buf = zstandard.ZstdCompressionDict(raw), b""
    context = zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()
    while True:
        buf = buf or stream.read(chunk)
        if not buf:
            return
        frame, parts, got = context.decompressobj(), [], 0
        while True:
            try:
                parts.append(frame.decompress(buf))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from None
            got += len(parts[-1])
            if p.max_record is not None and got > p.max_record:
                raise WarcError(f"a record is longer than {p.max_record} bytes")
            if frame.eof:
                buf = frame.unused_data
                break
            buf = stream.read(chunk)
            if not buf:
                raise WarcError("the last frame is cut off")
        yield b"".join(parts)


def _headers(raw: bytes, what: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in raw.decode("utf-8").split("\r\n") if raw else ():
        name, sep, value = line.partition(":")
        if not sep or not name or name != name.strip():
            raise WarcError(f"{what} has the malformed header line {line[:80]!r}")
        found[name.lower()] = value.strip()
    return found


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise WarcError(f"{what} has the Content-Length {value[:40]!r}")
    return int(value)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record, checked."""
    if not raw.startswith(VERSION):
        raise WarcError(f"a record begins with {raw[:12]!r}")
    head, sep, rest = raw[len(VERSION) :].partition(END)
    if not sep:
        raise WarcError("a record's header does not end")
    headers = _headers(head, "a record")
    if missing := [h for h in REQUIRED if not headers.get(h)]:
        raise WarcError(f"a record lacks {missing[0]}")
    n = _length(headers, "a record")
    if len(rest) != n + len(END) or rest[n:] != END:
        raise WarcError(f"a record's block has {len(rest) - len(END)} bytes, its Content-Length is {n}")
    return headers, rest[:n]


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes]:
    """Length, digest and bytes of the payload; a revisit gives the length and digest that it claims and no bytes."""
    head, sep, payload = block.partition(END)
    if not sep:
        raise WarcError("an HTTP head does not end")
    status, _, fields = head.partition(b"\r\n")
    if not status.startswith(b"HTTP/"):
        raise WarcError(f"an HTTP head begins with {status[:12]!r}")
    n = _length(_headers(fields, "an HTTP head"), "an HTTP head")
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind != "sha256" or len(digest) != 64:
        raise WarcError("a record has no SHA-256 payload digest")
    if headers["warc-type"] == "revisit":
        if payload or not headers.get("warc-refers-to"):
            raise WarcError("a revisit has a payload or refers to nothing")
        return n, digest, b""
    if len(payload) != n:
        raise WarcError(f"a payload has {len(payload)} bytes, its Content-Length is {n}")
    if hashlib.sha256(payload).hexdigest() != digest:
        raise WarcError("a payload does not match its digest")
    return n, digest, payload


def plan_records(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with the payload's digest and, for revisits, the page that they refer to.

    The digests are grouped on narrow rows. A page's role then comes back by an equi-join on its id and digest, whose
    other side holds revisits only; pages are shuffled just where that side is too large for Spark to broadcast."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    narrow = materialise(rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= LEAST_REVISIT)).select("page_id", "digest"), "warc-digests")
    copies = materialise(narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last"), "warc-copies")
    revisits = narrow.join(copies, "digest").where("page_id > refers_to").distinct()
    return rows.join(materialise(revisits, "warc-revisits"), ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, uri: str, p: WarcParams = WarcParams()) -> DataFrame:
    """Write pages into archives below uri; returns the manifest (path, records, bytes), which is itself written first.

    Tasks write to names of their own and the manifest lists those of successful attempts only, so lost executors and
    repeated attempts leave nothing that a reader of the manifest sees twice. uri may be any store that pyarrow opens."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        done: list[tuple[str, int, int]] = []
        held: list[bytes] = []
        out = archive = None
        held_bytes = 0

        def start():
            nonlocal out, archive
            out = store.open_output_stream(f"{root}/{name}-{len(done):04d}.warc.zst")
            archive = ArchiveWriter(out, held, p)
            for r in held:
                archive.add(r)
            held.clear()

        def finish():
            nonlocal out, archive
            out.close()
            done.append((f"{name}-{len(done):04d}.warc.zst", archive.records, archive.bytes))
            out = archive = None

        for batch in batches:
            for i in range(batch.num_rows):
                page, digest, url, html, refers = (c[i].as_py() for c in batch.columns)
                record = build_record(page, url, html.encode("utf-8"), digest, refers, p.date)
                if archive:
                    archive.add(record)
                    if archive.bytes >= p.archive_bytes:
                        finish()
                else:
                    held.append(record)
                    held_bytes += len(record)
                    if held_bytes >= p.sample_bytes:
                        start()
                        held_bytes = 0
        if held:
            start()
        if archive:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["path", "records", "bytes"])

    rows = plan_records(pages).select("page_id", "digest", "url", "html", "refers_to")
    return materialise(rows.mapInArrow(kernel, "path string, records long, bytes long"), "warc-manifest")


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("record_id", pa.string()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, uri: str, payloads: bool = False, p: WarcParams = WarcParams()) -> DataFrame:
    """The response and revisit records of a manifest's archives, checked; payloads are returned only if asked for."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(uri)
        number = lambda x: int(x) if x is not None else None
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, size, n = [], 0, 0
                with store.open_input_stream(f"{root}/{path}") as stream:
                    for raw in read_frames(stream, p):
                        n += 1
                        head, block = parse_record(raw)
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        length, digest, payload = payload_of(head, block)
                        rows.append((number(head.get("x-page-id")), length, digest, head["warc-type"], number(head.get("x-refers-to-page-id")), head.get("warc-target-uri"), head["warc-record-id"], payload if payloads else None))
                        size += len(rows[-1][-1] or b"") + 200
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)
                            rows, size = [], 0
                if n != expected:
                    raise WarcError(f"{path} has {n} records, the manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string, payload binary"
    # One archive per task: a round-robin deal of a few names.
    tasks = max(1, manifest.count())
    return manifest.select("path", "records").repartition(min(tasks, 20_000)).mapInArrow(kernel, schema)


def archive_pages(pages: DataFrame, uri: str | None = None, p: WarcParams = WarcParams()) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives and read them back: one row per page.

    Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is the response and the others
    are revisits of it. Defined cases: a null html is an empty payload; a null url is written as about:blank; a null
    page_id is always a response and is never referred to; rows with the smallest page_id that repeat it with the same
    payload are responses too; an empty table gives no rows; other columns are ignored."""
    uri = uri or new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, uri, p), uri, p=p)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
