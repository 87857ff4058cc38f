"""Burrows-Wheeler transforms of collections of short strings, and merging them by interleave refinement.

A collection is one array of symbols (1 and up) in which each string ends with 0. Its transform lists the symbol before each
rotation, in the order of the rotations. Two or more transforms are merged without sorting suffixes again: an interleave says which
collection each row of the merged transform comes from. It starts as all rows of the first, then of the second, and so on; one
round reads the collections' symbols in the present interleave and deals them stably by symbol, after which rows are in order of
one more symbol. The round in which two neighbours first differ gives their common prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64


@dataclass
class Transform:
    """``before``: the symbol before each rotation; ``places``: where in the symbols each rotation starts."""

    before: np.ndarray
    places: np.ndarray


def transform(symbols: np.ndarray) -> Transform:
    """By doubling the sorted prefix. Equal rotations (of equal strings) stay in the order of their strings."""
    n = symbols.size
    ends = np.flatnonzero(symbols == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = np.diff(np.concatenate([starts, [n]]))
    begin, length = np.repeat(starts, size), np.repeat(size, size)
    offset = np.arange(n) - begin
    rank = np.unique(symbols, return_inverse=True)[1].astype(U64)
    step, longest = 1, int(size.max(initial=0))
    while True:
        key = rank << U64(32) | rank[begin + (offset + step) % length]
        order = np.argsort(key)
        ordered = key[order]
        new = np.zeros(n, U64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, U64)
        rank[order] = np.cumsum(new, dtype=U64)
        step *= 2
        if step >= longest or int(rank.max(initial=0)) == n - 1:
            break
    order = np.argsort(rank << U64(32) | np.arange(n, dtype=U64))
    return Transform(symbols[begin + (offset - 1) % length][order], order)


def merge(parts: list[Transform], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common): which part each merged row is from, and how many symbols it shares with the row above, up to ``rounds``."""
    sizes = [p.before.size for p in parts]
    n = sum(sizes)
    symbols = np.concatenate([p.before for p in parts]).astype(U64)
    source = np.repeat(np.arange(len(parts), dtype=np.uint16), sizes)
    block = np.zeros(n, np.int64)
    common = np.full(n, rounds, np.int32)
    if n:
        common[0] = 0
    place = np.arange(n, dtype=U64)
    for done in range(rounds):
        read = np.empty(n, U64)
        read[np.argsort(source, kind="stable")] = symbols
        dealt = np.sort(read << U64(32) | place)
        order = (dealt & U64(0xFFFFFFFF)).astype(np.int64)
        first = dealt >> U64(32)
        source = source[order]
        old = block[order]
        new = np.ones(n, bool)
        new[1:] = (first[1:] != first[:-1]) | (old[1:] != old[:-1]) | (first[1:] == 0)
        fresh = new & (common == rounds)
        common[fresh] = done
        block = np.cumsum(new)
        if new.all():
            break
    return source, common


def rows_of(parts: list[Transform], source: np.ndarray, shifts: list[int]) -> np.ndarray:
    """The place of each merged row in the concatenation of the parts' symbols, part k starting at shifts[k]."""
    out = np.empty(source.size, np.int64)
    out[np.argsort(source, kind="stable")] = np.concatenate([p.places + s for p, s in zip(parts, shifts, strict=True)])
    return out
