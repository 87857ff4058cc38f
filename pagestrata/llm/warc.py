"""WARC archives: write pages with equal payloads once, and read archives back sequentially.

Writing: each partition appends records, one gzip member each, to segments of its own in the shared folder. Of pages with equal
payloads the one with the smallest page_id is a response; the others are revisits that name it. The list of finished segments is
itself a written table, so only segments of committed tasks are ever read, and a lost executor's half-written ones are not.

Reading: one pass over a segment's bytes in fixed chunks. Each member is inflated incrementally, its header is framed by the
first empty line and its block by Content-Length; the block's and the payload's digests are recomputed and compared. Memory is one
chunk and one header of any length; the payload is held only if asked for.

A page's text moves once, to the task of its payload's digest, where it learns which page is the response; digests of many pages are
dealt over salts.

Defined cases: a null html is an empty payload, and equal payloads of any length, 0 included, share one response; a null page_id
ranks after all others; pages tied on the smallest page_id, or all without one, are all responses; a null url is written as an empty
target, an url of any length in full; a text is held whole while it is written; an empty table makes no segment; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.shared import new_path, small_batches, spread_join, written
from pagestrata.sources import warcfile as wf
from pagestrata.storage import filesystem

SEGMENT_BYTES = 256 << 20
CHUNK = 1 << 18
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PAGE, FIRST = "Page-Id", "Refers-To-Page-Id"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: object) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}')}"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The response of a page, or the revisit that stands for it: its HTTP header alone, and where the payload is."""
    digest = f"sha1:{wf.base32_sha1(payload)}"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest)]
    if page_id is not None:
        headers.append((PAGE, str(page_id)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(refers_to)}>"), (FIRST, str(refers_to))]
    block = wf.http_block(200, "OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], b"" if revisit else payload)
    return wf.record("revisit" if revisit else "response", record_id(page_id), DATE, block, "application/http; msgtype=response", headers)


class _Segments:
    """The segments that one task writes."""

    def __init__(self, folder: str, limit: int):
        task = TaskContext.get()
        self.name = f"pages-{task.partitionId() if task else 0:06d}-{task.taskAttemptId() if task else 0}"
        self.folder, self.limit, self.out, self.done = folder, limit, None, []

    def append(self, data: bytes) -> None:
        if self.out and self.out[2] and self.out[1] + len(data) > self.limit:
            self.close()
        if not self.out:
            files, root = filesystem(self.folder)
            files.create_dir(root, recursive=True)
            name = f"{self.name}-{len(self.done):05d}.warc.gz"
            self.out = [files.open_output_stream(f"{root}/{name}", compression=None), 0, 0, f"{self.folder}/{name}"]
        self.out[0].write(data)
        self.out[1] += len(data)
        self.out[2] += 1

    def close(self) -> None:
        if self.out:
            self.out[0].close()
            self.done.append((self.out[3], self.out[1], self.out[2]))
            self.out = None


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int, level: int) -> Iterator[pa.RecordBatch]:
    segments = _Segments(folder, limit)
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for i in range(batch.num_rows):
            page_id, url, html, refers_to, revisit = (c[i].as_py() for c in columns)
            segments.append(wf.member(page_record(page_id, url, (html or "").encode(), refers_to, bool(revisit)), level))
    segments.close()
    paths, sizes, counts = zip(*segments.done, strict=True) if segments.done else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "bytes", "records"])


def write_pages(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, level: int = LEVEL) -> DataFrame:
    """Write the archive; returns its segments: path, bytes, records."""
    small_batches(pages.sparkSession)
    held = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    first = written(held.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("times")), "firsts")
    both = spread_join(held, first, "digest", F.xxhash64("page_id", "url")).select("page_id", "url", "html", F.col("first_id").alias("refers_to"), (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"))
    folder = new_path(pages.sparkSession, "warc")
    return written(both.mapInArrow(lambda it: _write(it, folder, segment_bytes, level), "path string, bytes long, records long"), "segments")


@dataclass
class Entry:
    """What one record says, and whether it held what it says."""

    kind: str | None
    headers: list
    block_bytes: int = 0
    payload_bytes: int = 0
    stated_bytes: int | None = None
    payload_digest: str | None = None
    problems: list = field(default_factory=list)
    payload: bytes | None = None


class _Framer:
    """Takes one member's bytes as they are inflated."""

    def __init__(self, keep: bool):
        self.buffer, self.entry, self.left, self.keep = bytearray(), None, 0, keep
        self.block, self.inner, self.body, self.tail, self.held = hashlib.sha1(), bytearray(), None, b"", []
        self.searched = 0

    def _empty_line(self, buffer: bytearray) -> int:
        """Where the first empty line begins, looking only at what is new; -1 while there is none."""
        end = buffer.find(b"\r\n\r\n", self.searched)
        self.searched = 0 if end >= 0 else max(0, len(buffer) - 3)
        return end

    def feed(self, data: bytes) -> None:
        if self.entry is None:
            self.buffer += data
            end = self._empty_line(self.buffer)
            if end < 0:
                return
            first, headers = wf.parse_headers(bytes(self.buffer[:end]))
            size = wf.first_value(headers, "Content-Length")
            if not first.startswith("WARC/") or size is None or not size.isdigit():
                raise ValueError("a gzip member that doesn't start with a WARC record")
            self.entry = Entry(wf.first_value(headers, "WARC-Type"), headers)
            self.left = int(size)
            self.http = "application/http" in (wf.first_value(headers, "Content-Type") or "")
            data, self.buffer = bytes(self.buffer[end + 4 :]), bytearray()
        part, rest = data[: self.left], data[self.left :]
        self.left -= len(part)
        self.tail += rest
        self.block.update(part)
        self.entry.block_bytes += len(part)
        if self.http and self.body is None:
            self.inner += part
            end = self._empty_line(self.inner)
            if end < 0:
                return
            _, inner = wf.parse_headers(bytes(self.inner[:end]))
            stated = wf.first_value(inner, "Content-Length")
            self.entry.stated_bytes = int(stated) if stated and stated.isdigit() else None
            part, self.inner, self.body = bytes(self.inner[end + 4 :]), bytearray(), hashlib.sha1()
        elif self.body is None:
            self.body = hashlib.sha1()
        self.body.update(part)
        self.entry.payload_bytes += len(part)
        if self.keep:
            self.held.append(part)

    def close(self) -> Entry:
        entry = self.entry
        if entry is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("a gzip member that doesn't hold one whole record")
        code = lambda h: base64.b32encode(h.digest()).decode()
        stated = wf.first_value(entry.headers, "WARC-Block-Digest")
        if stated and stated != f"sha1:{code(self.block)}":
            entry.problems.append("block digest")
        stated = wf.first_value(entry.headers, "WARC-Payload-Digest")
        entry.payload_digest = stated.removeprefix("sha1:") if stated else None
        if entry.kind == "response":
            if stated and stated != f"sha1:{code(self.body or hashlib.sha1())}":
                entry.problems.append("payload digest")
            if entry.stated_bytes not in (None, entry.payload_bytes):
                entry.problems.append("payload length")
        entry.payload = b"".join(self.held) if self.keep else None
        return entry


def read_records(stream, keep_payload: bool = False, chunk: int = CHUNK) -> Iterator[Entry]:
    """The records of one archive, in order; ``stream`` has read(n)."""
    data = stream.read(chunk)
    while data:
        inflate, framer = zlib.decompressobj(31), _Framer(keep_payload)
        while not inflate.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
            framer.feed(inflate.decompress(data, chunk))
            data = inflate.unconsumed_tail if not inflate.eof else inflate.unused_data
        yield framer.close()
        data = data or stream.read(chunk)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, inner = filesystem(path)
            with files.open_input_stream(inner, compression=None) as stream:
                rows = []
                for e in read_records(stream):
                    if e.problems:
                        raise ValueError(f"{path}: {', '.join(e.problems)} of {wf.first_value(e.headers, 'WARC-Record-ID')}")
                    own, first = wf.first_value(e.headers, PAGE), wf.first_value(e.headers, FIRST)
                    size = e.payload_bytes if e.kind == "response" else e.stated_bytes
                    rows.append((None if own is None else int(own), size, e.payload_digest, e.kind, int(first) if e.kind == "revisit" and first else None))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_pages(segments: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; a damaged record fails the job."""
    n = max(1, segments.count())
    return segments.select("path").repartition(n, "path").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
