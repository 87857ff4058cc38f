"""Substring dedup by fixed-block anchors: passages of 50 words or more that a document with a smaller doc_id has too.

Each document is cut into non-overlapping reference blocks of 25 words; any run of 50 words contains a whole block, so every
repeat of 50 words has an anchor. All rolling 25-word windows of all documents probe the blocks. Where a probe from another
document hits, the hit is extended: the 50-word windows around it are compared by hash across documents, consecutive equal
windows being the maximal exact repeat, and every window whose words also start in a document with a smaller doc_id is removed.
Only the smallest doc_id of each distinct window is looked for, so groups of copies never make pairs.

Layout: documents are dealt once into groups of a few MB (one exchange, used by all three passes). Per group and hash range one
blob holds sorted distinct hashes; hash ranges are compared with each other's groups, and answers go back to the groups that
asked. Nothing is collected or broadcast. Anchor hashes are 44 bits (a chance hit only costs work), window hashes 95 bits (at 1e13 windows, a chance
pair in one of 300 runs).

Defined cases: doc_id is any whole number of 64 bits; a null or empty text has no words (the SHA-256 is that of no bytes); a text
under 50 words is never cut; a text of any length is cut whole (it is scanned in pieces); a null doc_id counts as the largest number
and is never "smaller"; rows with equal doc_id don't take words from each other, and many copies of one row are dealt over groups;
an empty table gives an empty result; extra columns are dropped by ``removals`` and carried by ``dedup``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import blobs
from pagestrata.llm import textscan as ts
from pagestrata.llm.shared import core_memory, deal, group_size, groups_for, text_bytes

WINDOW = 50
BLOCK = WINDOW // 2
ANCHOR_BITS = 44
NO_ID = (1 << 63) - 1

_PART = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("seconds", pa.binary()), ("ids", pa.binary())])
_PART_DDL = "bucket int, g int, keys binary, seconds binary, ids binary"
_ANSWER = pa.schema([("g", pa.int32()), ("keys", pa.binary()), ("seconds", pa.binary()), ("ids", pa.binary())])
_ANSWER_DDL = "g int, keys binary, seconds binary, ids binary"
_ONE = np.uint64(1)


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in order, and the row of each."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, _, data, offs in ts.utf8_slices(table.column("text")):
        own, at = ts.word_hashes(data, offs)
        hashes.append(own)
        rows.append(at + lo)
    return np.concatenate(hashes), np.concatenate(rows)


def _ids(table: pa.Table) -> np.ndarray:
    """doc_id as an unsigned number in the same order."""
    return pc.fill_null(table.column("rank"), NO_ID).to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _anchors(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rolling windows of BLOCK words, and their hashes."""
    at = np.flatnonzero(ts.within_row(rows, BLOCK))
    return at, ts.window_hashes(words, BLOCK)[at] >> np.uint64(64 - ANCHOR_BITS) << np.uint64(64 - ANCHOR_BITS)


def _packed(keys: np.ndarray, more: tuple, cuts: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The ranges between cuts that have keys, and their keys (ascending) and further numbers as blobs; nulls where there are no such numbers."""
    some = np.flatnonzero(np.diff(cuts))
    blob = lambda f, x: pa.array([None if x is None else f(x[cuts[b] : cuts[b + 1]]) for b in some], pa.binary())
    return some, [blob(blobs.pack_sorted, keys), *(blob(blobs.pack, x) for x in more)]


def _by_bucket(g: int, keys: np.ndarray, seconds: np.ndarray | None, ids: np.ndarray | None, buckets: int) -> pa.Table:
    """One row for each hash range that has keys; keys ascend."""
    some, packed = _packed(keys, (seconds, ids), blobs.bucket_cuts(keys, buckets))
    return pa.Table.from_arrays([pa.array(some, pa.int32()), pa.array([g] * some.size, pa.int32()), *packed], schema=_PART)


@ts.gives_back
def _probes(table: pa.Table, buckets: int) -> pa.Table:
    """A group's distinct anchor hashes. Low bits: 1 it is a reference block here, 2 documents with different doc_id here have it."""
    words, rows = _words(table)
    at, keys = _anchors(words, rows)
    first = np.searchsorted(rows, rows[at])
    block = ((at - first) % BLOCK == 0).astype(np.uint64)
    ids = _ids(table)[rows[at]]
    order = np.argsort(keys)
    keys, block, ids = keys[order], block[order], ids[order]
    runs = blobs.run_starts(keys)
    if runs.size:
        several = np.minimum.reduceat(ids, runs) != np.maximum.reduceat(ids, runs)
        keys = keys[runs] | np.maximum.reduceat(block, runs) | several.astype(np.uint64) << np.uint64(1)
    g = table.column("g")[0].as_py() if table.num_rows else 0
    return _by_bucket(g, keys, None, None, buckets)


@ts.gives_back
def _hits(table: pa.Table) -> pa.Table:
    """One hash range of all groups: tell each group which of its anchors are reference blocks that another document has too."""
    groups = table.column("g").to_numpy()
    lists = [blobs.unpack_sorted(x.as_py()) for x in table.column("keys")]
    keys = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lists)), [x.size for x in lists])
    order = np.argsort(keys >> np.uint64(2))
    keys, owner = keys[order], owner[order]
    runs = blobs.run_starts(keys >> np.uint64(2))
    if runs.size:
        size = np.diff(np.concatenate([runs, [keys.size]]))
        flags = np.bitwise_or.reduceat(keys & np.uint64(3), runs)
        hot = np.repeat((flags & np.uint64(1) > 0) & ((size > 1) | (flags & np.uint64(2) > 0)), size)
        keys, owner = keys[hot] & ~np.uint64(3), owner[hot]
    return _answers(groups, keys, None, None, owner, len(lists))


def _answers(groups: np.ndarray, keys: np.ndarray, seconds: np.ndarray | None, ids: np.ndarray | None, owner: np.ndarray, n: int) -> pa.Table:
    order = np.lexsort((keys, owner) if seconds is None else (seconds, keys, owner))
    keys, owner = keys[order], owner[order]
    more = tuple(None if x is None else x[order] for x in (seconds, ids))
    some, packed = _packed(keys, more, np.searchsorted(owner, np.arange(n + 1)))
    return pa.Table.from_arrays([pa.array(groups[some], pa.int32()), *packed], schema=_ANSWER)


def _joined(table: pa.Table, column: str, ordered: bool) -> np.ndarray:
    open_ = blobs.unpack_sorted if ordered else blobs.unpack
    return np.concatenate([np.zeros(0, np.uint64), *(open_(x.as_py()) for x in table.column(column))])


@ts.gives_back
def _extend(table: pa.Table, hits: pa.Table, buckets: int) -> pa.Table:
    """The distinct 50-word windows of a group that contain a hit, each with its smallest doc_id and whether a larger one has it here."""
    if not table.num_rows or not hits.num_rows:
        return _PART.empty_table()
    words, rows = _words(table)
    at, anchors = _anchors(words, rows)
    hot = np.sort(_joined(hits, "keys", True))
    found = np.searchsorted(hot, anchors)
    marks = at[hot[np.minimum(found, hot.size - 1)] == anchors]
    near = ts.covered(np.maximum(marks - (WINDOW - BLOCK), 0), WINDOW - BLOCK + 1, words.size)
    whole = ts.within_row(rows, WINDOW)
    places = np.flatnonzero(whole & near[: whole.size])
    keys, seconds = _windows(words, places)
    ids = _ids(table)[rows[places]]
    order = np.lexsort((seconds, keys))
    keys, seconds, ids = keys[order], seconds[order], ids[order]
    runs = blobs.pair_starts(keys, seconds)
    if runs.size:
        low, high = np.minimum.reduceat(ids, runs), np.maximum.reduceat(ids, runs)
        keys, seconds, ids = keys[runs], seconds[runs] | (low != high).astype(np.uint64), low
    return _by_bucket(table.column("g")[0].as_py(), keys, seconds, ids, buckets)


def _windows(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows at these places; the second one has 31 bits above a low bit of 0."""
    return ts.window_hashes(words, WINDOW)[places], ts.window_hashes(words, WINDOW, 2)[places] >> np.uint64(33) << _ONE


@ts.gives_back
def _smallest(table: pa.Table) -> pa.Table:
    """One hash range of all groups: tell each group which of its windows a smaller doc_id than some of its own has, and that doc_id."""
    groups = table.column("g").to_numpy()
    lists = [blobs.unpack_sorted(x.as_py()) for x in table.column("keys")]
    keys, seconds, ids = np.concatenate([np.zeros(0, np.uint64), *lists]), _joined(table, "seconds", False), _joined(table, "ids", False)
    owner = np.repeat(np.arange(len(lists)), [x.size for x in lists])
    order = np.lexsort((seconds, keys))
    keys, seconds, ids, owner = keys[order], seconds[order], ids[order], owner[order]
    runs = blobs.pair_starts(keys, seconds & ~_ONE)
    if runs.size:
        low = np.repeat(np.minimum.reduceat(ids, runs), np.diff(np.concatenate([runs, [keys.size]])))
        tell = (low < ids) | (seconds & _ONE > 0)
        keys, seconds, ids, owner = keys[tell], seconds[tell] & ~_ONE, low[tell], owner[tell]
    return _answers(groups, keys, seconds, ids, owner, len(lists))


@ts.gives_back
def _cut(table: pa.Table, answers: pa.Table, keep_text: bool) -> pa.Table:
    """The final rows of a group."""
    n = table.num_rows
    words, rows = _words(table)
    gone = np.zeros(words.size, bool)
    if answers.num_rows and n:
        keys, seconds, low = _joined(answers, "keys", True), _joined(answers, "seconds", False), _joined(answers, "ids", False)
        order = np.lexsort((seconds, keys))
        keys, seconds, low = keys[order], seconds[order], low[order]
        places = np.flatnonzero(ts.within_row(rows, WINDOW))
        found = blobs.holds(keys, seconds, *_windows(words, places))
        marks = places[(found >= 0) & (low[found] < _ids(table)[rows[places]])]
        gone = ts.covered(marks, WINDOW, words.size)
    n_words = np.bincount(rows, minlength=n)
    removed = np.bincount(rows[gone], minlength=n)
    cuts = np.concatenate([[0], np.cumsum(n_words)])
    digests, texts = [], []
    for i, text in enumerate(table.column("text")):
        text = text.as_py()
        at, parts = cuts[i], []
        for piece in ts.text_pieces(np.frombuffer((text or "").encode(), np.uint8)):
            own = piece.tobytes().split()
            end = at + len(own)
            if removed[i]:
                own = [w for w, x in zip(own, gone[at:end], strict=True) if not x]
            at = end
            if own:
                parts.append(b" ".join(own))
        kept = b" ".join(parts)
        digests.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode() if removed[i] else text)
    out = table.drop_columns(["g", "rank"]) if keep_text else table.select(["doc_id"])
    if keep_text:
        out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
    for name, column in (("n_words", pa.array(n_words, pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("kept_sha256", pa.array(digests, pa.string()))):
        out = out.append_column(name, column)
    return out


def _run(docs: DataFrame, columns: list[str], keep_text: bool, group_bytes: int | None) -> DataFrame:
    """The result columns; column k of those carried is called ck."""
    total = text_bytes(docs)
    group_bytes = group_bytes or group_size(total, core_memory(docs.sparkSession))
    spread = 2 * docs.sparkSession.sparkContext.defaultParallelism
    groups = groups_for(total, group_bytes, spread)
    buckets = groups_for(total, 2 * group_bytes, spread)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text", *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    dealt = deal(named, groups, group_bytes).withColumn("rank", F.col("doc_id").cast("long")).repartition(groups_for(total, 2 * group_bytes, spread), "g")
    by_group = dealt.groupBy("g")
    probes = by_group.applyInArrow(lambda t: _probes(t, buckets), _PART_DDL)
    hits = probes.groupBy("bucket").applyInArrow(lambda t: _hits(t), _ANSWER_DDL)
    windows = by_group.cogroup(hits.groupBy("g")).applyInArrow(lambda a, b: _extend(a, b, buckets), _PART_DDL)
    answers = windows.groupBy("bucket").applyInArrow(lambda t: _smallest(t), _ANSWER_DDL)
    carried = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    fields = f"doc_id {kind}{', text string' if keep_text else ''}{carried}, n_words long, n_removed long, kept_sha256 string"
    return by_group.cogroup(answers.groupBy("g")).applyInArrow(lambda a, b: _cut(a, b, keep_text), fields)


def removals(docs: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return _run(docs, [], False, group_bytes)


def dedup(docs: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """The documents without repeated passages, with their own columns. Texts that lose nothing stay as they are; documents that lose all their words go. A column n_chars is counted anew where a text lost words."""
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = _run(docs, columns, True, group_bytes).where("n_removed = 0 or n_removed < n_words")
    if "n_chars" in columns:
        own = f"c{columns.index('n_chars')}"
        out = out.withColumn(own, F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(own)).cast(docs.schema["n_chars"].dataType))
    return out.select("doc_id", "text", *(F.col(f"c{i}").alias(c) for i, c in enumerate(columns))).select(*docs.columns)
