"""Copying, finding and repairing bundle files, each file a task's work; contents never pass through the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.sources import bundle
from pagestrata.storage import filesystem

CHUNK = 4 << 20
# fixed values: how deep and how wide a search for bundles goes
MAX_DEPTH = 3
MAX_DIRECTORIES = 400

_DONE = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("outcome", pa.string())])
_DONE_DDL = "name string, bytes long, sha256 string, outcome string"


def _digest(files, path: str) -> tuple[int, str]:
    code, size = hashlib.sha256(), 0
    with files.open_input_stream(path, compression=None) as source:
        while data := source.read(CHUNK):
            code.update(data)
            size += len(data)
    return size, code.hexdigest()


def _copy(batches: Iterator[pa.RecordBatch], source: str, target: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    (here, root), (there, goal) = filesystem(source), filesystem(target)
    for batch in batches:
        rows = []
        for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            info = there.get_file_info(f"{goal}/{name}")
            if info.type == fs.FileType.File and info.size == size and _digest(there, f"{goal}/{name}") == _digest(here, f"{root}/{name}"):
                rows.append((name, *_digest(there, f"{goal}/{name}"), "present"))
                continue
            there.create_dir(f"{goal}/{name}".rsplit("/", 1)[0], recursive=True)
            code = hashlib.sha256()
            with here.open_input_stream(f"{root}/{name}", compression=None) as a, there.open_output_stream(f"{goal}/{name}.part", compression=None) as b:
                while data := a.read(CHUNK):
                    code.update(data)
                    b.write(data)
            there.move(f"{goal}/{name}.part", f"{goal}/{name}")
            found = _digest(there, f"{goal}/{name}")
            rows.append((name, *found, "copied" if found[1] == code.hexdigest() else "damaged"))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DONE, strict=True)], schema=_DONE)


def copy_files(files: DataFrame, source: str, target: str) -> DataFrame:
    """Copy (name, bytes) in chunks under a temporary name, and digest what arrived; files that are there already, whole and equal, stay. Lazy: read the result to run it."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("name", "bytes").repartition(n, "name").mapInArrow(lambda it: _copy(it, source, target), _DONE_DDL)


def find_bundles(spark: SparkSession, path: str, depth: int = MAX_DEPTH, most: int = MAX_DIRECTORIES) -> DataFrame:
    """Directories with a manifest or an index within ``depth`` levels, but not those within another bundle; the first ``most`` of them by name."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path).toString().split("://")[-1].removeprefix("file:").rstrip("/")
    files = bundle.list_files(spark, path).where(F.col("name").rlike("^(manifest\\.json|index-.*\\.ndjson)$"))
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("directory")).distinct()
    inner = F.substring_index("directory", base, -1)
    rows = rows.withColumn("depth", F.length(inner) - F.length(F.replace(inner, F.lit("/"), F.lit("")))).where(F.col("depth") <= depth)
    above = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda k: F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.size(F.split("directory", "/")) - k), "/"))
    nested = rows.where("depth > 0").select("directory", F.explode(above).alias("outer")).join(rows.select(F.col("directory").alias("outer")), "outer", "left_semi")
    return rows.join(nested.select("directory").distinct(), "directory", "left_anti").select("directory", "depth").orderBy("directory").limit(most)


def repair_plan(files: DataFrame, index: DataFrame) -> DataFrame:
    """What recovery has to do: delete unindexed segments, cut unindexed tails; a segment shorter than its index is fatal."""
    cut = bundle.damaged_tails(files, index).select("name", F.when(F.col("damage") == "unindexed_tail", "truncate").otherwise("fatal").alias("action"), F.col("extent").alias("keep_bytes"))
    gone = bundle.unindexed_segments(files, index).select("name", F.lit("delete").alias("action"), F.lit(0).cast("long").alias("keep_bytes"))
    return cut.unionByName(gone)


def _repair(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = filesystem(folder)
    for batch in batches:
        for name, action, keep in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if action == "fatal":
                raise ValueError(f"{name}: the index points beyond its end")
            if action == "delete":
                files.delete_file(f"{root}/{name}")
                continue
            with files.open_input_stream(f"{root}/{name}", compression=None) as a, files.open_output_stream(f"{root}/{name}.part", compression=None) as b:
                left = keep
                while left and (data := a.read(min(CHUNK, left))):
                    b.write(data)
                    left -= len(data)
            files.move(f"{root}/{name}.part", f"{root}/{name}")
        yield batch


def repair(plan: DataFrame, folder: str) -> DataFrame:
    """Carry the plan out; lazy: read the result to run it. Running it again does no harm but to deleted files, so plan anew."""
    return plan.select("name", "action", "keep_bytes").mapInArrow(lambda it: _repair(it, folder), "name string, action string, keep_bytes long")
