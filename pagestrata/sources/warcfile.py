"""WARC/1.1 records as bytes: building blocks, one gzip member a record, and parsing one record that an index points at.

Headers are ordered name and value pairs, as duplicates and order matter. Offsets and lengths count bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Sequence

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
Header = tuple[str, str]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_block(first: bytes, headers: Iterable[Header]) -> bytes:
    lines = []
    for name, value in headers:
        if "\r" in value or "\n" in value:
            raise ValueError(f"the value of {name} holds a line end")
        lines.append(f"{name}: {value}".encode() + CRLF)
    return first + CRLF + b"".join(lines) + CRLF


def http_block(status: int, reason: str, headers: Sequence[Header], body: bytes) -> bytes:
    return header_block(f"HTTP/1.1 {status} {reason}".rstrip().encode(), headers) + body


def fields_block(fields: Iterable[Header]) -> bytes:
    """The content of a warcinfo record."""
    return b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields)


def warcinfo(record_id: str, date: str, filename: str, fields: Iterable[Header]) -> bytes:
    """The record at the head of a segment, which says what the segment is part of."""
    return record("warcinfo", record_id, date, fields_block(fields), "application/warc-fields", [("WARC-Filename", filename)])


def record(kind: str, record_id: str, date: str, block: bytes, content_type: str | None = None, headers: Iterable[Header] = ()) -> bytes:
    """One record: header, block, and the two line ends after it."""
    own = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *headers]
    if content_type:
        own.append(("Content-Type", content_type))
    own += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return header_block(VERSION, own) + block + CRLF + CRLF


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of its own, without a time stamp, so equal records make equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_headers(data: bytes) -> tuple[str, list[Header]]:
    """The first line and the pairs of a header block (without its closing empty line)."""
    first, *lines = data.split(CRLF)
    pairs = []
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            pairs.append((name.decode("utf-8", "replace").strip(), value.decode("utf-8", "replace").strip()))
    return first.decode("utf-8", "replace"), pairs


def first_value(headers: Iterable[Header], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def split_record(data: bytes) -> tuple[str, list[Header], bytes]:
    """First line, headers and block of one uncompressed record; the block is framed by Content-Length."""
    head, gap, rest = data.partition(CRLF + CRLF)
    first, headers = parse_headers(head)
    size = first_value(headers, "Content-Length")
    if not gap or not first.startswith("WARC/") or size is None or not size.isdigit() or len(rest) < int(size):
        raise ValueError("not a whole WARC record")
    return first, headers, rest[: int(size)]


def split_http(block: bytes) -> tuple[str, list[Header], bytes]:
    """Status line, headers and body of an HTTP response block."""
    head, _, body = block.partition(CRLF + CRLF)
    first, headers = parse_headers(head)
    return first, headers, body
