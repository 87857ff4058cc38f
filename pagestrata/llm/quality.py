"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

The target multinomial is estimated on all documents whose label says quality 1, the raw multinomial on all documents. Texts don't move
to meet their labels: up to ``BROADCAST_ROWS`` trusted ids are broadcast; more are joined with the ids of the documents only, and each
task that counts reads which of its rows are trusted. Where that fails, as rows come in another order each time they are read, texts are
joined. Both multinomials are over word unigrams and bigrams hashed to ``BUCKETS`` buckets. Each bucket has ``SMOOTHING`` more counts in
the raw corpus, and the same share of them in the target, so an n-gram that is seen a few times says little, whether its document was
labelled or not. A document's score is the mean log ratio of its n-grams, and every document is kept or rejected by the same threshold.

Defined cases: a null or empty text has no words and fails the base rule; a null doc_id never matches a label; a doc_id labelled
more than once is trusted only if all its labels say 1; repeated rows are counted and judged one by one; a text of any length is
judged whole (its words are scanned in pieces); without any trusted label there is no target, all ratios are 0 and every document
that passes the base rule is kept; an empty table gives an empty result; extra columns are ignored by ``measure`` and carried by
``filter_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import blobs
from pagestrata.llm import textscan as ts
from pagestrata.llm.shared import BROADCAST_ROWS, new_path, release, small_batches
from pagestrata.storage import filesystem

BUCKETS = 1 << 22
#: Buckets whose counts travel together.
RANGE = 1 << 14
#: N-grams that a task counts before it hands its counts on, so that 32 bits hold them (a single text is under 2^31 bytes).
MOST_COUNTS = 1 << 31
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition, and bits of the partition's number whose trusted places share a folder.
ROW_BITS = 33
FOLDER_BITS = 4
SMOOTHING = 30
#: Mean log ratio below which a text is nearer to the rest of the corpus than to the target; the margin spares clean texts from noise.
THRESHOLD = -0.15
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CHAR = np.ones(256, np.uint8)
_CHAR[0x80:0xC0] = 0
_CHAR[list(b" \t\n\x0b\x0c\r")] = 0
FIELDS = "first long, raw binary, target binary"
ONE = np.uint32(1)  # of the counts' own kind: others are added far more slowly
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _buckets(words: np.ndarray, rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each unigram and bigram."""
    pair = ts.within_row(rows, 2)
    two = ts.mix((words[:-1] * _SECOND + words[1:])[pair]) if words.size > 1 else words[:0]
    return np.concatenate([words, two]) % np.uint64(buckets), np.concatenate([rows, rows[:-1][pair]] if words.size > 1 else [rows])


@ts.gives_back
def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    raw, target, room = np.zeros(buckets, np.uint32), np.zeros(buckets, np.uint32), MOST_COUNTS

    def parts() -> Iterator[pa.RecordBatch]:
        for at in range(0, buckets, RANGE):
            if raw[at : at + RANGE].any():
                yield _part(at, raw[at : at + RANGE], target[at : at + RANGE])

    for batch in batches:
        trusted = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
        for lo, hi, data, offs in ts.utf8_slices(batch.column(0)):
            where, rows = _buckets(*ts.word_hashes(data, offs), buckets)
            if where.size > room:
                yield from parts()
                raw[:], target[:], room = 0, 0, MOST_COUNTS
            room -= where.size
            where = where.astype(np.int64)
            np.add.at(raw, where, ONE)
            np.add.at(target, where[trusted[lo:hi][rows]], ONE)
    yield from parts()


def _part(at: int, raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([blobs.pack(x)], pa.binary()) for x in (raw, target))], names=["first", "raw", "target"])


@ts.gives_back
def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the counts of each range of buckets; only the sums are held."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for at, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = tuple(blobs.unpack(x).astype(np.int64) for x in counts)
            held[at] = tuple(a + b for a, b in zip(held[at], counts, strict=True)) if at in held else counts
    for at, counts in held.items():
        yield _part(at, *counts)


def _own_places(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the trusted rows of a partition, ascending, and the hashes of their ids; one place more that no row has ends them."""
    files, root = filesystem(folder)
    inner = f"{root}/folder={part >> FOLDER_BITS}"
    places, marks = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if files.get_file_info(inner).type == FileType.Directory:
        at = ds.field("at")
        found = ds.dataset(inner, filesystem=files, format="parquet").to_table(filter=(at >= part << ROW_BITS) & (at < (part + 1) << ROW_BITS))
        places, marks = found["at"].to_numpy(), found["mark"].to_numpy()
        order = np.argsort(places)
        places, marks = places[order], marks[order]
    return np.append(places, np.iinfo(np.int64).max), np.append(marks, 0)


@ts.gives_back
def _count_placed(batches: Iterator[pa.RecordBatch], buckets: int, folder: str) -> Iterator[pa.RecordBatch]:
    """As ``_count``, for (text, at, mark); how many trusted rows were found is given as the counts of the range -1."""
    met = 0

    def marked() -> Iterator[pa.RecordBatch]:
        nonlocal met
        places = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, mark = (batch.column(k).to_numpy() for k in (1, 2))
            if places is None:
                places, marks = _own_places(folder, int(at[0]) >> ROW_BITS)
            spot = np.searchsorted(places, at)
            trusted = (places[spot] == at) & (marks[spot] == mark)
            met += int(trusted.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trusted)], names=["text", "trusted"])

    yield from _count(marked(), buckets)
    yield _part(-1, np.array([met]), np.array([met]))


def _sums(counts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Raw and target counts by bucket, and those of the range -1."""
    raw, target, met = np.zeros(buckets), np.zeros(buckets), 0
    for r in counts.repartition("first").mapInArrow(_add, FIELDS).collect():
        if r.first < 0:
            met = int(blobs.unpack(r.raw)[0])
            continue
        for total, blob in ((raw, r.raw), (target, r.target)):
            part = blobs.unpack(blob)
            total[r.first : r.first + part.size] = part
    return raw, target, met


def _sums_by_place(docs: DataFrame, trusted: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Raw and target counts, for any number of trusted ids. Only ids are shuffled: the places of trusted rows are written, some
    partitions to a folder, and read by the tasks that count. None if a trusted row was not at its place, so that rows moved between the reads."""
    spark = docs.sparkSession
    path = new_path(spark, "trusted")
    place, mark = F.monotonically_increasing_id().alias("at"), F.xxhash64("doc_id").alias("mark")
    places = docs.select("doc_id", place).join(trusted.select("doc_id"), "doc_id").select("at", mark, F.shiftright("at", ROW_BITS + FOLDER_BITS).alias("folder"))
    places.repartition("folder").sortWithinPartitions("folder", "at").write.partitionBy("folder").option("compression", "zstd").parquet(path)
    n = spark.read.schema("at long, mark long").parquet(path).count()
    raw, target, met = _sums(docs.select("text", place, mark).mapInArrow(lambda it: _count_placed(it, buckets, path), FIELDS), buckets)
    release(spark, [path])
    return (raw, target) if met == n else None


def _sums_by_join(docs: DataFrame, trusted: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts by a join with the texts; rows without an id stay out of it."""
    own = docs.select("doc_id", "text")
    marked = own.where("doc_id is not null").join(trusted, "doc_id", "left").select("text", "trusted")
    marked = marked.unionByName(own.where("doc_id is null").select("text", F.lit(False).alias("trusted")))
    return _sums(marked.mapInArrow(lambda it: _count(it, buckets), FIELDS), buckets)[:2]


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p(target) - log p(raw) by bucket. Counts cover every document and every label; what reaches the driver is two numbers a bucket."""
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("trusted")).where("trusted")
    if trusted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marked = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left").select("text", "trusted")
        raw, target, _ = _sums(marked.mapInArrow(lambda it: _count(it, buckets), FIELDS), buckets)
    else:
        raw, target = _sums_by_place(docs, trusted, buckets) or _sums_by_join(docs, trusted, buckets)
    where = np.flatnonzero(raw)
    raw, target = raw[where], target[where]
    ratios = np.zeros(buckets, np.float32)
    if target.sum() > 0:
        rate = target.sum() / raw.sum()
        ratios[where] = np.log((target + SMOOTHING * rate) / (rate * (raw + SMOOTHING)))
    return ratios


def _repeat_words(words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Words by row that lie in a window of five words found twice or more in that row."""
    whole = np.flatnonzero(ts.within_row(rows, WINDOW))
    if not whole.size:
        return np.zeros(n_rows, np.int64)
    keys = ts.window_hashes(words, WINDOW)[whole]
    keys ^= ts.mix(rows[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(ordered.size, bool)
    twice[1:] |= same
    twice[:-1] |= same
    inside = ts.covered(whole[order[twice]], WINDOW, words.size)
    return np.bincount(rows[inside], minlength=n_rows)


def _dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line in seen:
            found += 1
        elif line.strip():
            seen.add(line)
    return found


@ts.gives_back
def _measure(batches: Iterator[pa.RecordBatch], ratios: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])
    for batch in batches:
        own = batch.schema.names[:-1]
        parts = [[] for _ in schema]
        for _, _, data, offs in ts.utf8_slices(batch.column(batch.num_columns - 1)):
            n = offs.size - 1
            words, rows = ts.word_hashes(data, offs)
            n_words = np.bincount(rows, minlength=n)
            raw = data.tobytes()
            lines = np.fromiter((_dup_lines(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)), np.int64, n)
            repeat = _repeat_words(words, rows, n)
            where, at = _buckets(words, rows, ratios.size)
            grams = np.bincount(at, minlength=n)
            score = np.bincount(at, weights=ratios[where.astype(np.int64)], minlength=n) / np.maximum(grams, 1)
            failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
            for part, x in zip(parts, (n_words, ts.per_row(_CHAR[data], offs), ts.per_row(_SYMBOL[data], offs), lines, repeat, failed, score, ~failed & (score >= threshold)), strict=True):
                part.append(x)
        columns = [pa.array(np.concatenate(p), f.type) if p else pa.array([], f.type) for p, f in zip(parts, schema, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *columns], names=[*own, *schema.names])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _measured(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...], threshold: float, buckets: int) -> DataFrame:
    """The result columns; column k of those carried is called ck."""
    small_batches(docs.sparkSession)
    ratios = log_ratios(docs, labels, buckets)
    kept = [docs[c].alias(f"c{i}") for i, c in enumerate(carry)]
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return docs.select(*kept, docs["text"].alias("whole_text")).mapInArrow(lambda it: _measure(it, ratios, threshold), f"{fields}, {RESULT}")


def measure(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The ``carry`` columns of each document, its base counts, score and verdict. Two scans of the texts, and no shuffle of them unless ``log_ratios`` must join them."""
    out = _measured(docs, labels, carry, threshold, buckets)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The documents that are kept, with their own columns."""
    out = _measured(docs, labels, tuple(docs.columns), threshold, buckets).where("kept")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
