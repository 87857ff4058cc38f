"""Vectorised scanning of UTF-8 text held in Arrow columns: words, word hashes and window hashes.

All functions work on one slice of a column at a time (about a MB of bytes, or one longer text, which is scanned in pieces), so
memory is bounded by the slice, and for the longest single text by its bytes and 16 bytes a word. A word is ``[^\\x20\\x09-\\x0D]+``; those six separators are single bytes in
UTF-8, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import isgeneratorfunction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Words longer than this are hashed by their blocks of this size, so one endless word does not make the column loop long.
LONG_WORD = 512

# what Arrow frees goes back to the system: workers idle for long beside the JVM
pa.set_memory_pool(pa.system_memory_pool())

_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # where the C library has it


def gives_back(work: Callable) -> Callable:
    """A worker's function, after which freed memory goes back to the system too."""
    if isgeneratorfunction(work):
        @wraps(work)
        def run(*args):
            yield from work(*args)
            _trim(0)
    else:
        @wraps(work)
        def run(*args):
            try:
                return work(*args)
            finally:
                _trim(0)
    return run


U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [(1 << 64) - 1], dtype=U64)
_M1, _M2, _LEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def utf8_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for consecutive runs of rows; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offs = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def find_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of each word; words do not cross rows."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    before = np.empty(data.size, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(data.size, bool)
    after[-1], after[:-1] = True, space[1:]
    inner = offs[(offs > 0) & (offs < data.size)]
    before[inner], after[inner - 1] = True, True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    rows = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, rows


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, from its length and its 8-byte pieces."""
    if not starts.size:
        return np.zeros(0, U64)
    padded = np.zeros(data.size + 8, np.uint8)
    padded[: data.size] = data
    at = np.ndarray(shape=(data.size + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    h = mix(length.astype(U64) * _LEN + U64(seed))
    h ^= at[starts] & _MASKS[np.minimum(length, 8)]
    mix(h)
    left = np.flatnonzero(length > 8)
    done = 8
    while left.size:
        if done >= LONG_WORD:
            for i in left:
                h[i] = _hash_long(data[starts[i] + done : ends[i]], h[i])
            break
        part = at[starts[left] + done] & _MASKS[np.minimum(length[left] - done, 8)]
        h[left] = mix((h[left] * _LEN) ^ part)
        done += 8
        left = left[length[left] > done]
    return h


def _hash_long(piece: np.ndarray, start) -> np.uint64:
    from hashlib import blake2b

    return U64(int.from_bytes(blake2b(piece.tobytes(), digest_size=8, key=int(start).to_bytes(8, "little")).digest(), "little"))


def text_pieces(data: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """One text in pieces of about ``limit`` bytes, cut where a word ends (a longer word stays whole)."""
    at = 0
    while at < data.size:
        to = min(data.size, at + limit)
        while to < data.size and not _SPACE[data[to]]:
            gaps = np.flatnonzero(_SPACE[data[to : to + limit]])
            to = to + int(gaps[0]) if gaps.size else min(data.size, to + limit)
        yield data[at:to]
        at = to


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of a slice; a long text is scanned in pieces."""
    if offs.size == 2 and data.size > 2 * SLICE_BYTES:
        parts = []
        for piece in text_pieces(data):
            starts, ends, _ = find_words(piece, np.array([0, piece.size]))
            parts.append(hash_spans(piece, starts, ends))
        hashes = np.concatenate(parts)
        return hashes, np.zeros(hashes.size, np.int64)
    starts, ends, rows = find_words(data, offs)
    return hash_spans(data, starts, ends), rows


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = {1: 0x9FB21C651E98DF25, 2: 0xD6E8FEB86659FD93}


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    have = _POWERS.get(lane)
    if have is None or have[0].size < n:
        size = max(n, 1 << 16)
        base = _BASES[lane]
        with np.errstate(over="ignore"):
            pair = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (base, pow(base, -1, 1 << 64)))
        if size > 1 << 22:
            return pair
        _POWERS[lane] = have = pair
    return have


def window_hashes(words: np.ndarray, size: int, lane: int = 1) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes, by differences of a running polynomial sum; crossing rows is the caller's to mask."""
    n = words.size - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _powers(words.size + 1, lane)
    total = np.zeros(words.size + 1, U64)
    np.cumsum(words * up[: words.size], out=total[1:])
    out = total[size:] - total[:n]
    out *= down[:n]
    return mix(out)


def within_row(rows: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` consecutive words stay in one row."""
    n = rows.size - size + 1
    return rows[:n] == rows[size - 1 :] if n > 0 else np.zeros(0, bool)


def covered(marks: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of ``length`` places lie in one of the runs of ``size`` places that start at the marked ones."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, marks, 1)
    np.add.at(step, np.minimum(marks + size, length), -1)
    return np.cumsum(step[:-1]) > 0


def per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive offsets."""
    if offs.size == 2:
        return np.array([values.sum(dtype=np.int64)])
    total = np.zeros(values.size + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
