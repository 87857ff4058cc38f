"""Suffix-array dedup: bytes that lie in a 200-byte string which starts anywhere else too, in any document.

Work is split by anchors. A 200-byte window's anchor is its 32-byte piece with the smallest hash (the first of equals), so equal
windows have equal anchors at the same place, and the windows of one anchor occurrence make one segment of text. Only anchors that
occur more than once go on. A segment whose whole text occurs twice is repeated throughout; where segments of one anchor differ,
one copy of each is brought together with the others of its anchor.

An anchor with more than ``MOST_TEXTS`` differing segments would grow with the corpus in one task. Its segments' windows are counted
by hash instead, spread over all tasks and aggregated in each group of documents first.

Where segments are brought together, they are read as words of 8 bytes counted from the anchor, which equal windows cut alike. Each shard of segments gets
its Burrows-Wheeler transform, and the transforms are merged by interleave refinement. The rounds give common prefixes in words,
the first differing words give them in bytes, and the repeated intervals of at least 200 - d bytes, split by the d bytes before
(the transform's own column), are exactly the windows that start d bytes before a word and occur again. Answers go back to the
group of documents that asked; nothing is collected or broadcast.

Defined cases: a null text is empty (the SHA-256 is that of no bytes); texts under 200 bytes lose nothing; a text of any length is
cut whole (it is scanned in pieces, each window start in one of them); matches never cross documents but may be in one; rows with
equal or null doc_id are documents of their own, and many copies of one row are dealt over groups; an empty table gives an empty
result; extra columns are ignored. Segments of one anchor (64 bits) are told apart by 61-bit hashes of their text, counted windows
by 95-bit ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagestrata.llm import blobs, bwt
from pagestrata.llm import textscan as ts
from pagestrata.llm.shared import core_memory, deal, group_size, groups_for, text_bytes

WINDOW = 200
ANCHOR = 32
SPAN = WINDOW - ANCHOR + 1
WORD = 8
ROUNDS = WINDOW // WORD + 1
SHARD_SYMBOLS = 1 << 16
#: Text that is compared at a time; a single anchor's segments may be more.
BATCH_BYTES = 1 << 20
U64 = np.uint64
FULL, SHIP, COUNT = U64(1), U64(2), U64(4)
_CODE = U64(7)
#: Different texts of one anchor that are brought together, 368 bytes each at most; beyond it their windows are counted.
MOST_TEXTS = 4096

_PART = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("anchors", pa.binary()), ("keys", pa.binary()), ("texts", pa.binary())])
_PART_DDL = "bucket int, g int, anchors binary, keys binary, texts binary"
_ANSWER = pa.schema([("g", pa.int32()), ("keys", pa.binary()), ("ranges", pa.binary()), ("seconds", pa.binary())])
_ANSWER_DDL = "g int, keys binary, ranges binary, seconds binary"
#: Bits of a place in a slice or piece of text, under which an anchor's hash is kept.
PLACE_BITS = U64(24)
#: Longer texts are scanned in pieces that overlap by a window.
PIECE_BYTES = 1 << 20


class Segments:
    """The segments of one slice of texts, or of a piece of a longer text that begins at byte ``base``: first byte, end, place of the anchor, the anchor's hash, and a key of the text (low three bits 0)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, base: int = 0):
        n = data.size
        self.data, self.base, self.prefix = data, base, {}
        none = np.zeros(0, np.int64)
        self.start = self.end = self.anchor = none
        self.hash = self.key = np.zeros(0, U64)
        if n < WINDOW:
            return
        grams = self._hashes(np.arange(n - ANCHOR + 1), ANCHOR)
        low = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(grams.size, dtype=U64)
        width = 1
        while 2 * width <= SPAN:
            low = np.minimum(low[: low.size - width], low[width:])
            width *= 2
        m = n - WINDOW + 1
        low = np.minimum(low[:m], low[SPAN - width : SPAN - width + m])
        rows = np.repeat(np.arange(offs.size - 1, dtype=np.int32), np.diff(offs))
        at = np.flatnonzero(rows[:m] == rows[WINDOW - 1 :])
        if not at.size:
            return
        anchor = (low[at] & ((U64(1) << PLACE_BITS) - U64(1))).astype(np.int64)
        new = np.ones(at.size, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [at.size]]) - 1
        start, end, anchor = at[first], at[last] + WINDOW, anchor[first]
        self.hash = ts.mix(grams[anchor])  # the smallest hashes, spread over the whole range again
        text = self._hashes(start, end - start)
        self.key = ts.mix(text ^ ts.mix(self.hash + (anchor - start).astype(U64) * U64(512) + (end - start).astype(U64))) & ~_CODE
        self.start, self.end, self.anchor = start + base, end + base, anchor + base

    def _hashes(self, at: np.ndarray, size, lane: int = 1) -> np.ndarray:
        """Hashes of the bytes from some places on."""
        if lane not in self.prefix:
            n = self.data.size
            up, down = ts._powers(n + 1, lane)
            total = np.zeros(n + 1, U64)
            np.cumsum((ts.mix(np.arange(256, dtype=U64) + U64(lane)))[self.data] * up[:n], out=total[1:])
            self.prefix[lane] = total, down
        total, down = self.prefix[lane]
        return ts.mix((total[at + size] - total[at]) * down[at])

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, hash, another hash of 31 bits above a low bit of 0) of the windows of some segments."""
        size = self.end[chosen] - self.start[chosen] - WINDOW + 1
        at = np.repeat(self.start[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return at, self._hashes(at - self.base, WINDOW), self._hashes(at - self.base, WINDOW, 2) >> U64(33) << U64(1)


def _slices(table: pa.Table):
    """(bytes, offsets, their Segments one after another) of runs of rows."""
    for _, _, data, offs in ts.utf8_slices(table.column("text")):
        if data.size <= 2 * PIECE_BYTES:
            yield data, offs, iter([Segments(data, offs)])
        else:
            yield data, offs, (Segments(p, np.array([0, p.size]), at) for at in range(0, data.size, PIECE_BYTES) for p in [data[at : at + PIECE_BYTES + WINDOW - 1]])


def _segments(table: pa.Table):
    for _, _, found in _slices(table):
        yield from found


def _group(table: pa.Table) -> int:
    return table.column("g")[0].as_py() if table.num_rows else 0


@ts.gives_back
def _probes(table: pa.Table, buckets: int) -> pa.Table:
    """A group's distinct segments, by anchor; bit 1 of a key: more than once here."""
    found = [(s.hash, s.key) for s in _segments(table)]
    hashes = np.concatenate([np.zeros(0, U64), *(f[0] for f in found)])
    keys = np.concatenate([np.zeros(0, U64), *(f[1] for f in found)])
    order = np.lexsort((keys, hashes))
    hashes, keys = hashes[order], keys[order]
    runs = blobs.run_starts(keys)
    again = np.diff(np.concatenate([runs, [keys.size]])) > 1
    hashes, keys = hashes[runs], keys[runs] | again.astype(U64)
    cuts = blobs.bucket_cuts(hashes, buckets)
    some = np.flatnonzero(np.diff(cuts))
    columns = [pa.array(some, pa.int32()), pa.array([_group(table)] * some.size, pa.int32())]
    columns += [pa.array([f(x[cuts[b] : cuts[b + 1]]) for b in some], pa.binary()) for f, x in ((blobs.pack_sorted, hashes), (blobs.pack, keys))]
    return pa.Table.from_arrays([*columns, pa.nulls(some.size, pa.binary())], schema=_PART)


def _answers(groups: np.ndarray, owner: np.ndarray, keys: np.ndarray, ranges: np.ndarray | None = None, seconds: np.ndarray | None = None) -> pa.Table:
    order = np.lexsort((keys, owner) if seconds is None else (seconds, keys, owner))
    owner, keys = owner[order], keys[order]
    cuts = np.searchsorted(owner, np.arange(groups.size + 1))
    some = np.flatnonzero(np.diff(cuts))
    packed = [blobs.pack_sorted(keys[cuts[k] : cuts[k + 1]]) for k in some]
    more = [[None if x is None else blobs.pack(x[order][cuts[k] : cuts[k + 1]]) for k in some] for x in (ranges, seconds)]
    return pa.Table.from_arrays([pa.array(groups[some], pa.int32()), *(pa.array(x, pa.binary()) for x in (packed, *more))], schema=_ANSWER)


@ts.gives_back
def _sift(table: pa.Table, most_texts: int) -> pa.Table:
    """One hash range: which segments are repeated as they are (FULL), and which must be compared (SHIP, one copy of each text of an anchor)."""
    groups = table.column("g").to_numpy()
    hashes = [blobs.unpack_sorted(x.as_py()) for x in table.column("anchors")]
    owner = np.repeat(np.arange(len(hashes)), [x.size for x in hashes])
    hashes = np.concatenate([np.zeros(0, U64), *hashes])
    keys = np.concatenate([np.zeros(0, U64), *(blobs.unpack(x.as_py()) for x in table.column("keys"))])
    order = np.lexsort((keys, hashes))
    hashes, keys, owner = hashes[order], keys[order], owner[order]
    if not keys.size:
        return _ANSWER.empty_table()
    plain = keys & ~_CODE
    new_text = np.ones(keys.size, bool)
    new_text[1:] = (plain[1:] != plain[:-1]) | (hashes[1:] != hashes[:-1])
    runs = np.flatnonzero(new_text)
    size = np.diff(np.concatenate([runs, [keys.size]]))
    full = np.repeat((size > 1) | (np.bitwise_or.reduceat(keys, runs) & U64(1) > 0), size)
    families = blobs.run_starts(hashes)
    texts = np.repeat(np.add.reduceat(new_text.astype(np.int64), families), np.diff(np.concatenate([families, [keys.size]])))
    many = texts > most_texts
    ship = (texts > 1) & ~many & new_text
    code = full.astype(U64) * FULL | ship.astype(U64) * SHIP | many.astype(U64) * COUNT
    tell = code > 0
    return _answers(groups, owner[tell], plain[tell] | code[tell])


def _told(table: pa.Table) -> np.ndarray:
    """Keys with codes, ascending."""
    return np.sort(np.concatenate([np.zeros(0, U64), *(blobs.unpack_sorted(x.as_py()) for x in table.column("keys"))]))


def _code(told: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The code of each key, 0 if none was told."""
    if not told.size:
        return np.zeros(keys.size, U64)
    at = np.minimum(np.searchsorted(told, keys), told.size - 1)
    return np.where(told[at] & ~_CODE == keys, told[at] & _CODE, U64(0))


@ts.gives_back
def _ship(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """One copy of each segment that must be compared, and the distinct windows of those that are counted (low bit: more than once here)."""
    told = _told(answers)
    told = told[told & (SHIP | COUNT) > 0]
    none = np.zeros(0, U64)
    hashes, keys, meta, texts, seen, counted = [none], [none], [none], [], none, [(none, none)]
    for s in _segments(table) if told.size else ():
        code = _code(told, s.key)
        if (count := np.flatnonzero(code & COUNT > 0)).size:
            counted.append(s.windows(count)[1:])
        one = np.flatnonzero(code & SHIP > 0)
        one = one[np.unique(s.key[one], return_index=True)[1]]
        one = one[~np.isin(s.key[one], seen)]
        seen = np.concatenate([seen, s.key[one]])
        hashes.append(s.hash[one])
        keys.append(s.key[one] | code[one])
        meta.append(((s.end - s.start)[one].astype(U64) << U64(32)) | (s.anchor - s.start)[one].astype(U64))
        raw = s.data.tobytes()
        texts += [raw[a:b] for a, b in zip(s.start[one] - s.base, s.end[one] - s.base, strict=True)]
    hashes, keys, meta = np.concatenate(hashes), np.concatenate(keys), np.concatenate(meta)
    order = np.argsort(hashes, kind="stable")
    cuts = blobs.bucket_cuts(hashes[order], buckets)
    rows = []
    for b in np.flatnonzero(np.diff(cuts)):
        part = order[cuts[b] : cuts[b + 1]]
        rows.append((b, blobs.pack(meta[part]), blobs.pack(keys[part]), pa.compress(b"".join(texts[i] for i in part), codec="zstd", asbytes=True)))
    windows, seconds = (np.concatenate(x) for x in zip(*counted, strict=True))
    order = np.lexsort((seconds, windows))
    windows, seconds = windows[order], seconds[order]
    runs = blobs.pair_starts(windows, seconds)
    again = np.diff(np.concatenate([runs, [windows.size]])) > 1
    windows, seconds = windows[runs], seconds[runs] | again.astype(U64)
    cuts = blobs.bucket_cuts(windows, buckets)
    rows += [(b, blobs.pack(seconds[cuts[b] : cuts[b + 1]]), blobs.pack_sorted(windows[cuts[b] : cuts[b + 1]]), None) for b in np.flatnonzero(np.diff(cuts))]
    if not rows:
        return _PART.empty_table()
    bucket, anchors, packed, joined = zip(*rows, strict=True)
    return pa.Table.from_arrays([pa.array(bucket, pa.int32()), pa.array([_group(table)] * len(rows), pa.int32()), *(pa.array(x, pa.binary()) for x in (anchors, packed, joined))], schema=_PART)


def repeated_starts(text: np.ndarray, lengths: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Of segments laid end to end: which bytes start a WINDOW that another place of the segments starts too."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    head = anchors % WORD
    words = -((head - lengths) // WORD)
    begin = np.concatenate([[0], np.cumsum(words + 1)[:-1]])
    n = int((words + 1).sum())
    segment = np.repeat(np.arange(lengths.size), words + 1)
    index = np.arange(n) - begin[segment]
    byte = starts[segment] + head[segment] + WORD * index
    left = np.maximum(lengths[segment] - head[segment] - WORD * index, 0)
    last = index == words[segment]
    left[last] = 0
    padded = np.concatenate([np.zeros(WORD, np.uint8), text, np.zeros(WORD, np.uint8)])
    view = np.ndarray(shape=(text.size + WORD + 1,), dtype=">u8", buffer=padded.data, strides=(1,))
    value = view[np.minimum(byte, text.size) + WORD].astype(U64)
    size = np.minimum(left, WORD)
    value &= np.where(size > 0, ~U64(0) << (U64(8) * (WORD - np.maximum(size, 1)).astype(U64)), U64(0))
    before = view[np.minimum(byte, text.size)].astype(U64)
    room = head[segment] + WORD * index

    order = np.lexsort((size, value))
    new = np.ones(n, bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (size[order][1:] != size[order][:-1])
    symbols = np.empty(n, np.int64)
    symbols[order] = np.cumsum(new)
    symbols[last] = 0

    cuts = [0]
    ends = np.concatenate([begin[1:], [n]])
    while cuts[-1] < n:
        cuts.append(int(ends[min(np.searchsorted(ends, cuts[-1] + SHARD_SYMBOLS), ends.size - 1)]))
    shards = [bwt.transform(symbols[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    source, common = bwt.merge(shards, ROUNDS)
    rows = bwt.rows_of(shards, source, cuts[:-1])

    shared = common.astype(np.int64) * WORD
    near = np.flatnonzero((common == WINDOW // WORD - 1) & (np.arange(n) > 0))
    if near.size:
        k = WINDOW // WORD - 1
        one, two = rows[near], rows[near - 1]
        inside = (left[one] > WORD * k) & (left[two] > WORD * k)
        near, one, two = near[inside], one[inside] + k, two[inside] + k
        differ = value[one] ^ value[two]
        for j in range(1, WORD):
            shared[near] += (differ >> U64(64 - 8 * j) == 0).astype(np.int64)
    shared = np.minimum(shared, left[rows])
    shared[1:] = np.minimum(shared[1:], left[rows[:-1]])

    out = np.zeros(text.size, bool)
    for d in range(WORD):
        breaks = shared < WINDOW - d
        kin = ~breaks
        kin[:-1] |= ~breaks[1:]
        kin &= room[rows] >= d
        chosen = np.flatnonzero(kin)
        interval = np.cumsum(breaks)[chosen].astype(U64)
        tail = before[rows[chosen]] & (U64((1 << 8 * d) - 1))
        group = ts.mix(ts.mix(tail + U64(d)) ^ interval)
        order = np.argsort(group)
        same = group[order][1:] == group[order][:-1]
        twice = np.zeros(chosen.size, bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[byte[rows[chosen[order[twice]]]] - d] = True
    return out


def _repeated_runs(text: np.ndarray, lengths: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first byte, end) of the repeated runs in segments laid end to end, counted within each."""
    inside = ts.covered(np.flatnonzero(repeated_starts(text, lengths, anchors)), WINDOW, text.size)
    ends = np.cumsum(lengths)
    edge = np.zeros(text.size + 1, bool)
    edge[0] = edge[ends] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    which = np.searchsorted(ends, lo, side="right")
    base = ends[which] - lengths[which]
    return which, lo - base, hi - base


def _count(table: pa.Table) -> pa.Table:
    """Windows of one hash range that occur again, for each group that has them."""
    lists = [blobs.unpack_sorted(x.as_py()) for x in table.column("keys")]
    owner = np.repeat(np.arange(len(lists)), [x.size for x in lists])
    keys = np.concatenate([np.zeros(0, U64), *lists])
    seconds = np.concatenate([np.zeros(0, U64), *(blobs.unpack(x.as_py()) for x in table.column("anchors"))])
    order = np.lexsort((seconds, keys))
    keys, seconds, owner = keys[order], seconds[order], owner[order]
    runs = blobs.pair_starts(keys, seconds & ~U64(1))
    if runs.size:
        size = np.diff(np.concatenate([runs, [keys.size]]))
        again = np.repeat((size > 1) | (np.bitwise_or.reduceat(seconds, runs) & U64(1) > 0), size)
        keys, seconds, owner = keys[again], seconds[again] & ~U64(1), owner[again]
    return _answers(table.column("g").to_numpy(), owner, keys, seconds=seconds)


@ts.gives_back
def _compare(table: pa.Table) -> pa.Table:
    """One hash range: the windows that are counted, and the repeated runs of the segments that are compared."""
    text = pc.is_valid(table.column("texts"))
    return pa.concat_tables([_count(table.filter(pc.invert(text))), _align(table.filter(text))])


def _align(table: pa.Table) -> pa.Table:
    """The repeated runs of each segment that is not repeated as it is. Anchors are taken together up to BATCH_BYTES, each whole."""
    groups = table.column("g").to_numpy()
    keys = [blobs.unpack(x.as_py()) for x in table.column("keys")]
    owner = np.repeat(np.arange(len(keys)), [x.size for x in keys])
    keys = np.concatenate([np.zeros(0, U64), *keys])
    meta = np.concatenate([np.zeros(0, U64), *(blobs.unpack(x.as_py()) for x in table.column("anchors"))])
    if not keys.size:
        return _ANSWER.empty_table()
    lengths, anchors = (meta >> U64(32)).astype(np.int64), (meta & U64(0xFFFFFFFF)).astype(np.int64)
    firsts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    sizes = np.add.reduceat(lengths, firsts)
    text = np.frombuffer(b"".join(pa.decompress(x.as_py(), decompressed_size=int(n), codec="zstd", asbytes=True) for x, n in zip(table.column("texts"), sizes, strict=True)), np.uint8)
    starts = np.cumsum(lengths) - lengths
    family = ts.hash_spans(text, starts + anchors, starts + anchors + ANCHOR)
    order = np.argsort(family, kind="stable")
    edges = np.concatenate([blobs.run_starts(family[order]), [keys.size]])
    filled = np.concatenate([[0], np.cumsum(lengths[order])])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < edges.size - 1:
        to = max(at + 1, int(np.searchsorted(filled[edges], filled[edges[at]] + BATCH_BYTES, side="right")) - 1)
        part = order[edges[at] : edges[to]]
        size = lengths[part]
        spots = np.repeat(starts[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        which, lo, hi = _repeated_runs(text[spots], size, anchors[part])
        which = part[which]
        open_ = keys[which] & FULL == 0
        found.append((which[open_], lo[open_], hi[open_]))
        at = to
    which, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    return _answers(groups, owner[which], keys[which] & ~_CODE, (lo.astype(U64) << U64(32)) | hi.astype(U64))


@ts.gives_back
def _cut(table: pa.Table, answers: pa.Table) -> pa.Table:
    n = table.num_rows
    ranged, paired = (pc.is_valid(answers.column(c)) for c in ("ranges", "seconds"))
    told = _told(answers.filter(pc.invert(pc.or_(ranged, paired))))
    numbers = lambda t, c, f=blobs.unpack: np.concatenate([np.zeros(0, U64), *(f(x.as_py()) for x in t.column(c))])
    some, pairs = answers.filter(ranged), answers.filter(paired)
    keys, ranges = numbers(some, "keys", blobs.unpack_sorted), numbers(some, "ranges")
    order = np.argsort(keys, kind="stable")
    keys, ranges = keys[order], ranges[order]
    counted, seconds = numbers(pairs, "keys", blobs.unpack_sorted), numbers(pairs, "seconds")
    order = np.lexsort((seconds, counted))
    counted, seconds = counted[order], seconds[order]
    size, removed, spans, digests = [], [], [], []
    for data, offs, found in _slices(table):
        step = np.zeros(data.size + 1, np.int32)
        for s in found:
            code = _code(told, s.key)
            full = code & FULL > 0
            np.add.at(step, s.start[full], 1)
            np.add.at(step, s.end[full], -1)
            if counted.size and (open_ := np.flatnonzero((code & COUNT > 0) & ~full)).size:
                at, windows, others = s.windows(open_)
                again = at[blobs.holds(counted, seconds, windows, others) >= 0]
                np.add.at(step, again, 1)
                np.add.at(step, again + WINDOW, -1)
            first, last = np.searchsorted(keys, s.key), np.searchsorted(keys, s.key, side="right")
            many = last - first
            at = np.repeat(s.start, many)
            pick = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if many.size else np.zeros(0, np.int64)
            np.add.at(step, at + (ranges[pick] >> U64(32)).astype(np.int64), 1)
            np.add.at(step, at + (ranges[pick] & U64(0xFFFFFFFF)).astype(np.int64), -1)
        gone = np.cumsum(step[:-1], out=step[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        begins[heads] = gone[heads]
        size.append(np.diff(offs))
        removed.append(ts.per_row(gone, offs))
        spans.append(ts.per_row(begins, offs))
        for a, b, k in zip(offs[:-1], offs[1:], removed[-1], strict=True):
            own = data[a:b]
            digests.append(hashlib.sha256(own[~gone[a:b]].tobytes() if k else own.tobytes()).hexdigest())
    flat = lambda x: pa.array(np.concatenate(x) if n else [], pa.int64())
    return pa.Table.from_arrays([table.column("doc_id"), flat(size), flat(removed), flat(spans), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removals(docs: DataFrame, group_bytes: int | None = None, most_texts: int = MOST_TEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")
    total = text_bytes(docs)
    group_bytes = group_bytes or group_size(total, core_memory(docs.sparkSession))
    spread = 2 * docs.sparkSession.sparkContext.defaultParallelism
    groups = buckets = groups_for(total, group_bytes, spread)
    kind = docs.schema["doc_id"].dataType.simpleString()
    by_group = deal(docs, groups, group_bytes).repartition(groups_for(total, 2 * group_bytes, spread), "g").groupBy("g")
    probes = by_group.applyInArrow(lambda t: _probes(t, buckets), _PART_DDL)
    sifted = probes.groupBy("bucket").applyInArrow(lambda t: _sift(t, most_texts), _ANSWER_DDL)
    shipped = by_group.cogroup(sifted.groupBy("g")).applyInArrow(lambda a, b: _ship(a, b, buckets), _PART_DDL)
    # a fixed number of tasks: packed texts look too small to be dealt out by their bytes
    compared = shipped.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _compare(t), _ANSWER_DDL)
    return by_group.cogroup(sifted.unionByName(compared).groupBy("g")).applyInArrow(lambda a, b: _cut(a, b), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
