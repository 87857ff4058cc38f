"""Number lists as compact bytes, for shuffles of many small numbers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, so that planes which hardly vary vanish."""
    planes = np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8).T
    return values.size.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers, as differences."""
    steps = values.copy()
    steps[1:] -= values[:-1]
    return pack(steps)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def bucket_cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Places in ascending 64-bit hashes where each of ``buckets`` equal ranges begins, and the end."""
    return np.concatenate([[0], np.searchsorted(values, _edges(buckets)), [values.size]]).astype(np.int64)


@lru_cache(maxsize=4)
def _edges(buckets: int) -> np.ndarray:
    return np.array([((k << 64) + buckets - 1) // buckets for k in range(1, buckets)], dtype=np.uint64)


def holds(keys: np.ndarray, seconds: np.ndarray, own: np.ndarray, own_seconds: np.ndarray) -> np.ndarray:
    """Where each of some pairs of numbers is among pairs that ascend; -1 if it isn't."""
    found = np.full(own.size, -1, np.int64)
    if not keys.size:
        return found
    at = np.searchsorted(keys, own)
    open_ = np.flatnonzero(keys[np.minimum(at, keys.size - 1)] == own)
    while open_.size:
        spot = at[open_]
        fits = seconds[spot] == own_seconds[open_]
        found[open_[fits]] = spot[fits]
        # hashes of one number may differ in the other: look at the next
        open_ = open_[~fits]
        at[open_] += 1
        open_ = open_[at[open_] < keys.size]
        open_ = open_[keys[at[open_]] == own[open_]]
    return found


def pair_starts(keys: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Where each run of equal pairs begins."""
    if not keys.size:
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]) | (seconds[1:] != seconds[:-1])) + 1])


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    if not ordered.size:
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
