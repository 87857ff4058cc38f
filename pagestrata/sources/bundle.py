"""Bundles: NDJSON indexes, JSON manifests, file listings, and segments of WARC records with an index of where each record is.

Writing is one pass: rows are ordered by ``seq`` within a lane, a lane's task folds them into segments of their kind (a new one when
the next record would pass the limit and the segment has any), each headed by a warcinfo record, and returns the index rows. Lanes
write side by side. Reading a record takes its segment, offset and length from the index and reads just those bytes; rows of one
segment are read together, in order.

Captures have ``seq``, ``url`` and ``body``. Any other column of an index row that they have goes into the index as it is, and
``headers``, ``status_line`` and ``written_at`` into the record; what is missing is null, or has the default in ``DEFAULTS``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagestrata import schemas
from pagestrata.functions import ids, urls
from pagestrata.functions.times import warc_date
from pagestrata.sources import warcfile as wf
from pagestrata.storage import filesystem

SEGMENT_BYTES = 256 << 20


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows; a line that can't be read fails the job."""
    return spark.read.schema(schemas.CAPTURES).option("mode", "FAILFAST").json(path)


def read_index_lenient(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good index rows, and the lines that are none (such as a last line cut short)."""
    rows = spark.read.schema(schemas.CAPTURES + ", broken_line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken_line").json(path).cache()
    return rows.where("broken_line is null").drop("broken_line"), rows.where("broken_line is not null").select("broken_line")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def coverage_table(manifests: DataFrame) -> DataFrame:
    return manifests.select("bundle_id", F.inline("coverage"))


def state_table(manifests: DataFrame) -> DataFrame:
    return manifests.select("bundle_id", F.inline("crawl_state"))


def segment_table(manifests: DataFrame) -> DataFrame:
    return manifests.select("bundle_id", F.inline("segments"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, directory, name, bytes) of every file below that isn't empty; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    return found.select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("directory"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "bytes")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def identity_conflicts(names: DataFrame) -> DataFrame:
    """Directories whose manifest, index and name don't agree on one bundle id."""
    return names.groupBy("directory").agg(F.count_distinct("bundle_id").alias("ids")).where("ids > 1")


# fixed values: what a capture is unless it says otherwise
DEFAULTS = {"kind": "data", "http_status": 200, "surface": "html", "capture_fidelity": "raw", "intent": "", "route_key": "", "verdict": "unknown"}
HEADERS = "array<struct<name:string,value:string>>"
FORMAT, CONFORMS_TO, SOFTWARE = "WARC File Format 1.1", "https://iipc.github.io/warc-specifications/", "pagestrata/1"
EPOCH = "1970-01-01T00:00:00Z"
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

#: What writing a record finds out; the other columns of an index row are carried.
_PLACED = pa.schema([("segment", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content_sha256", pa.string()), ("warc_record_id", pa.string())])
_PLACED_DDL = "segment string, offset long, length long, content_sha256 string, warc_record_id string"
_WRITTEN = ("kind", "capture_id", "url", "status_line", "headers", "written_at", "body")


class _Segments:
    """The segments that one lane writes, one kind after another."""

    def __init__(self, folder: str, limit: int, level: int, part_of: str, software: str):
        self.files, self.root = filesystem(folder)
        self.files.create_dir(self.root, recursive=True)
        task = TaskContext.get()
        self.lane = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        self.limit, self.level, self.part_of, self.software = limit, level, part_of, software
        self.out, self.kind, self.name, self.at, self.count, self.number = None, None, "", 0, 0, 0

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None

    def append(self, kind: str, data: bytes, date: str) -> tuple[str, int, int]:
        if self.out is None or kind != self.kind or (self.count and self.at + len(data) > self.limit):
            self.close()
            self.number = self.number + 1 if kind == self.kind else 1
            self.kind, self.at, self.count = kind, 0, 0
            self.name = f"{kind}-{self.lane}-{self.number:05d}.warc.gz"
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
            fields = [("software", self.software), ("format", FORMAT), ("isPartOf", self.part_of), ("conformsTo", CONFORMS_TO)]
            head = wf.member(wf.warcinfo(f"urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{self.part_of}/{self.name}')}", date, self.name, fields), self.level)
            self.out.write(head)
            self.at = len(head)
        self.out.write(data)
        place = self.name, self.at, len(data)
        self.at, self.count = self.at + len(data), self.count + 1
        return place


def _fold(batches: Iterator[pa.RecordBatch], folder: str, limit: int, level: int, part_of: str, software: str) -> Iterator[pa.RecordBatch]:
    segments = _Segments(folder, limit, level, part_of, software)
    for batch in batches:
        rows = []
        own = len(batch.schema.names) - len(_WRITTEN)
        for kind, capture, url, status, headers, date, body in zip(*(batch.column(own + i).to_pylist() for i in range(len(_WRITTEN))), strict=True):
            payload = body or b""
            record_id = f"urn:uuid:{uuid.uuid5(RECORD_SPACE, capture)}"
            block = wf.header_block(status.encode(), [(h["name"], h["value"]) for h in headers or ()]) + payload
            record = wf.record("response", record_id, date, block, "application/http;msgtype=response", [("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{wf.base32_sha1(payload)}")])
            rows.append((*segments.append(kind, wf.member(record, level), date), hashlib.sha256(payload).hexdigest(), record_id))
        if rows:
            placed = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACED, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *placed], names=[*batch.schema.names[:own], *_PLACED.names])
    segments.close()


def write_captures(captures: DataFrame, folder: str, index_path: str, lanes: int, limit: int = SEGMENT_BYTES, level: int = 6, bundle_id: str = "19700101T000000Z-000000", software: str = SOFTWARE) -> DataFrame:
    """Write captures as segments in ``folder`` and their index as a table at ``index_path``; returns the index, with ``seq``.

    The index is written before it is read, so it names only segments of committed tasks; those of lost attempts are undeclared
    files, which ``unindexed_segments`` finds. A header value with a line end fails the job.
    """
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schemas.CAPTURES)}
    found = set(_PLACED.names)
    have = lambda c, kind: F.col(c).cast(kind) if c in captures.columns else F.lit(None).cast(kind)
    value = lambda c, kind: F.coalesce(have(c, kind), F.lit(DEFAULTS[c]).cast(kind)) if c in DEFAULTS else have(c, kind)
    date = F.coalesce(warc_date(have("written_at", "timestamp")), F.lit(EPOCH))
    made = {
        "capture_id": F.coalesce(have("capture_id", "string"), ids.capture_id(F.lit(bundle_id), F.col("seq"))),
        "url_key": F.coalesce(have("url_key", "string"), urls.url_key(F.col("url"))),
        "url_key_rules": F.lit(urls.KEY_RULES),
        "observed_at": F.coalesce(have("observed_at", "string"), date),
    }
    carried = {c: made.get(c, value(c, kind)) for c, kind in kinds.items() if c not in found}
    status = F.coalesce(have("status_line", "string"), F.concat(F.lit("HTTP/1.1 "), value("http_status", "int").cast("string")))
    written = (value("kind", "string"), carried["capture_id"], F.col("url"), status, have("headers", HEADERS), date, F.col("body"))
    rows = captures.select("seq", *(x.alias(c) for c, x in carried.items()), *(x.alias(f"w{i}") for i, x in enumerate(written)))
    ordered = rows.repartitionByRange(lanes, "seq").sortWithinPartitions("w0", "seq")
    fields = ", ".join(["seq long", *(f"{c} {kinds[c]}" for c in carried), _PLACED_DDL])
    ordered.mapInArrow(lambda it: _fold(it, folder, limit, level, bundle_id, software), fields).write.json(index_path)
    return captures.sparkSession.read.schema(f"seq long, {schemas.CAPTURES}").json(index_path)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = filesystem(folder)
    stream, opened = None, None
    for batch in batches:
        out = []
        for seq, segment, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if segment != opened:
                if stream is not None:
                    stream.close()
                stream, opened = files.open_input_file(f"{root}/{segment}"), segment
            stream.seek(offset)
            _, headers, block = wf.split_record(zlib.decompress(stream.read(length), 31))
            status, inner, body = wf.split_http(block)
            pairs = [[{"name": k, "value": x} for k, x in h] for h in (headers, inner)]
            out.append((seq, wf.first_value(headers, "WARC-Target-URI"), pairs[0], status, pairs[1], body))
        if out:
            pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
            kinds = (pa.int64(), pa.string(), pair, pa.string(), pair, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["seq", "url", "headers", "status_line", "http_headers", "body"])
    if stream is not None:
        stream.close()


def read_captures(index: DataFrame, folder: str) -> DataFrame:
    """The records that index rows point at: filter the index first, and only their bytes are read."""
    rows = index.select("seq", "segment", "offset", "length").repartition("segment").sortWithinPartitions("segment", "offset")
    return rows.mapInArrow(lambda it: _read(it, folder), f"seq long, url string, headers {HEADERS}, status_line string, http_headers {HEADERS}, body binary")


def _heads(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = filesystem(folder)
    for batch in batches:
        rows = []
        for name in batch.column(0).to_pylist():
            inflate = zlib.decompressobj(31)
            with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                data = b""
                while not inflate.eof and (part := stream.read(1 << 14)):
                    data += inflate.decompress(part)
            _, headers, block = wf.split_record(data)
            _, fields = wf.parse_headers(b"\r\n" + block.rstrip(b"\r\n"))
            rows.append((name, wf.first_value(headers, "WARC-Type"), wf.first_value(headers, "WARC-Filename"), dict(fields)))
        if rows:
            kinds = (pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["segment", "warc_type", "filename", "fields"])


def segment_heads(segments: DataFrame, folder: str) -> DataFrame:
    """The first record of each segment (column ``segment``), a few KB of each being read: its type, the file name that it says, and its fields."""
    return segments.select("segment").distinct().mapInArrow(lambda it: _heads(it, folder), "segment string, warc_type string, filename string, fields map<string,string>")


def describe_segments(files: DataFrame, index: DataFrame) -> DataFrame:
    """Manifest rows of segments: the file's bytes and digest (``files``: name, bytes, sha256), and its indexed records, the first and the last."""
    seen = index.groupBy("segment").agg(F.count("*").alias("record_count"), F.min_by("capture_id", "offset").alias("first_capture_id"), F.max_by("capture_id", "offset").alias("last_capture_id"))
    both = files.withColumnRenamed("name", "segment").join(seen, "segment")
    return both.select(F.col("segment").alias("filename"), "bytes", "sha256", "record_count", "first_capture_id", "last_capture_id")


def cross_check(segments: DataFrame, index: DataFrame) -> DataFrame:
    """(filename, record_count, indexed, problem): declared segments whose records aren't those that the index has, and indexed segments that aren't declared."""
    seen = index.groupBy(F.col("segment").alias("filename")).agg(F.count("*").alias("indexed"))
    both = segments.select("filename", "record_count").join(seen, "filename", "full")
    problem = F.when(F.col("record_count").isNull(), "undeclared").when(F.col("record_count") != F.coalesce("indexed", F.lit(0)), "count_mismatch")
    return both.select("filename", "record_count", F.coalesce("indexed", F.lit(0)).alias("indexed"), problem.alias("problem")).where("problem is not null")


def unindexed_segments(files: DataFrame, index: DataFrame) -> DataFrame:
    """Segment files that no index row points at."""
    return files.where(F.endswith("name", F.lit(".warc.gz"))).join(index.select(F.col("segment").alias("name")).distinct(), "name", "left_anti")


def damaged_tails(files: DataFrame, index: DataFrame) -> DataFrame:
    """Segments with bytes after the last indexed record (to cut), or with fewer bytes than the index says (fatal)."""
    ends = index.groupBy(F.col("segment").alias("name")).agg(F.max(F.col("offset") + F.col("length")).alias("extent"))
    both = files.join(ends, "name")
    return both.where("bytes <> extent").select("name", "bytes", "extent", F.when(F.col("bytes") > F.col("extent"), "unindexed_tail").otherwise("missing_bytes").alias("damage"))


def build_manifest(bundle: DataFrame, segments: DataFrame, state: DataFrame, coverage: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One JSON text a bundle, from its tables. With an index (of the same bundles), segments and index must agree, or no manifest is made."""
    if index is not None and (wrong := cross_check(segments, index).limit(5).collect()):
        raise ValueError("segments and index don't agree: " + "; ".join(f"{r.filename}: {r.problem} ({r.record_count} declared, {r.indexed} indexed)" for r in wrong))

    def gathered(df: DataFrame, name: str, order: str) -> DataFrame:
        fields = [c for c in df.columns if c != "bundle_id"]
        return df.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(name))

    out = bundle.join(gathered(segments, "segments", "filename"), "bundle_id", "left").join(gathered(state, "crawl_state", "route_key"), "bundle_id", "left").join(gathered(coverage, "coverage", "route_key"), "bundle_id", "left")
    return out.select("bundle_id", F.to_json(F.struct(*out.columns)).alias("manifest"))
