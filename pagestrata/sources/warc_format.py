"""``spark.read.format("warc")``: records of whole archives, one task a file, one gzip member a record."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagestrata.sources import warcfile as wf
from pagestrata.storage import filesystem

SCHEMA = "path string, offset long, length long, record_type string, record_id string, target_uri string, date string, block binary"
CHUNK = 1 << 18


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


def members(stream, chunk: int = CHUNK) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, inflated bytes) of each gzip member."""
    data, offset = stream.read(chunk), 0
    while data:
        inflate, out, length = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
            out.append(inflate.decompress(data))
            length += len(data) - len(inflate.unused_data)
            data = inflate.unused_data
        yield offset, length, b"".join(out)
        offset += length
        data = data or stream.read(chunk)


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        from pyarrow import fs

        files, root = filesystem(self.path)
        if files.get_file_info(root).type == fs.FileType.File:
            return [FilePart(self.path)]
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        return [FilePart(self.path.rstrip("/") + f.path[len(root) :]) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".warc.gz")]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        files, inner = filesystem(partition.path)
        with files.open_input_stream(inner, compression=None) as stream:
            for offset, length, data in members(stream):
                _, headers, block = wf.split_record(data)
                own = lambda name, headers=headers: wf.first_value(headers, name)
                yield partition.path, offset, length, own("WARC-Type"), (own("WARC-Record-ID") or "").strip("<>"), own("WARC-Target-URI"), own("WARC-Date"), block


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])
