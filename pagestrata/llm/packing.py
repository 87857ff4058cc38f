"""Packing token streams into fixed windows by Karmarkar-Karp multiway differencing.

Documents are tokenised (word by word through a cache: no token of these tokenizers crosses white space), an end id is added,
and whole documents are dealt by hash into groups of about ``GROUP_BYTES`` of text. In a group, whole windows are cut off long
documents first, and what is left of each is cut into equal pieces of at most ``capacity // CUTS`` ids. The pieces are spread over as
many windows as their ids need: differencing repeatedly takes the two partial partitions with the largest imbalances and merges
them with the fullest windows of one against the emptiest of the other, until one partition of near-equal windows is left. Where a
window exceeds its capacity, the number of windows rises and the pieces are spread anew. Padding is under one in a hundred ids on
documents of a thousand ids; larger pieces would be harder to level.

Defined cases: a null or empty text is a document of the end id alone; documents with equal or null doc_id are packed one by one, and
many copies of one row are dealt over groups; a text or word of any length is tokenised whole; an empty table has no pieces; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import json
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagestrata.llm import textscan as ts
from pagestrata.llm.shared import deal, groups_for, small_batches, text_bytes

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
GROUP_BYTES = 2 << 20
#: What is left of a document after whole windows is cut into pieces of this part of a window at most.
CUTS = 4
#: Words whose ids a worker keeps, from one task to the next; others are tokenised each time.
CACHED_WORDS = 50_000

_TOKENIZERS: dict = {}
_WORDS: dict = {}


def tokenizer(path: str | None = None):
    """The tokenizer in the file at ``path``; by default the public word-level one."""
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
    return _TOKENIZERS[path]


class _Known(dict):
    """Ids of words as bytes; a word that isn't known is looked up, and kept while there is room."""

    def __init__(self, look_up, kind: str):
        self.look_up, self.code = look_up, "H" if kind == "<u2" else "I"

    def __missing__(self, word: bytes) -> bytes:
        found = array(self.code, self.look_up(word)).tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = found
        return found


class WordIds:
    """Ids of texts as bytes.

    For a word-level BPE (lower case, white space dropped, words ending in an end mark) a text is split at ASCII white space,
    which no token crosses, and each distinct word is looked up once: its merges are done by a rank-ordered merger, with the end
    mark as a byte that UTF-8 never has. Words beyond Latin letters, and special tokens, are left to the tokenizer itself, and so
    are all texts of other kinds of tokenizers. The ids are the same either way.
    """

    def __init__(self, path: str | None, kind: str):
        self.tokenizer, self.kind, self.known = tokenizer(path), kind, _Known(self._word, kind)
        self.merge = _merger(self.tokenizer)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.merge is None:
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(f.ids, self.kind).tobytes() for f in found]
        look = self.known.__getitem__
        return [b"".join(map(look, (t if SPECIAL in t else t.lower()).split())) for t in texts]

    def _word(self, word: bytes) -> list[int]:
        merge = self.merge
        text = word.decode()
        if max(text) > LAST_PLAIN or SPECIAL in word:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        low = text.lower()  # up to LAST_PLAIN, all text is in form C and lower case does not depend on neighbours
        core = low.rstrip(STOPS)
        if not core or core.isalpha():
            tail = low[len(core) :]
            return (merge(core.encode() + END_MARK) if core else []) + (merge(tail.encode() + END_MARK) if tail else [])
        return [i for piece in PIECES.findall(low) for i in merge(piece.encode() + END_MARK)]


# fixed values: how the word-level tokenizer splits, and its end mark
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
PIECES = regex.compile(PATTERN)
END_MARK = b"\xff"
STOPS = ".,!?;:#*$%&"
SPECIAL = b"<|"
LAST_PLAIN = "\u024f"


def _merger(tokens):
    """A function from a word's bytes and the end mark to its ids; None for other kinds of tokenizers."""
    told = json.loads(tokens.to_str())
    model = told["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or PATTERN not in json.dumps(told["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
        return None
    import tiktoken

    byte_of, spare = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            byte_of[chr(byte)] = byte
        else:
            byte_of[chr(256 + spare)] = byte
            spare += 1
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {}
    for token, rank in model["vocab"].items():
        if token not in special:
            ends = token.endswith(WORD_END) and token != WORD_END
            ranks[bytes(byte_of[c] for c in (token[: -len(WORD_END)] if ends else token)) + END_MARK * ends] = rank
    if len(set(ranks.values())) != len(ranks):
        return None
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@ts.gives_back
def _tokenise(batches: Iterator[pa.RecordBatch], path: str | None, kind: str) -> Iterator[pa.RecordBatch]:
    words = _WORDS.get((path, kind)) or _WORDS.setdefault((path, kind), WordIds(path, kind))
    end = np.array([END_ID], kind).tobytes()
    for batch in batches:
        for lo, hi, data, offs in ts.utf8_slices(batch.column(2)):
            if offs.size == 2 and words.merge:  # words are tokenised one by one, so a text is too
                ids = [b"".join(x for piece in ts.text_pieces(data) for x in words.encode([piece.tobytes()])) + end]
            else:
                raw = data.tobytes()
                ids = [x + end for x in words.encode([raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(ids, pa.binary())], names=["doc_id", "g", "ids"])


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each of ``windows`` windows. A partition lists its windows that have items as (-sum, turn, items), the fullest first."""
    heap: list = [(-s, i, [(-s, i, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = max(0, len(a) + len(b) - windows)
        cut = len(a) - over
        joined = [(x[0] + y[0], min(x[1], y[1]), x[2] + y[2]) for x, y in zip(a[cut:], reversed(b[len(b) - over :]), strict=True)]
        del a[cut:]
        joined += b[: len(b) - over]
        if len(joined) == 1:
            bisect.insort(a, joined[0])
        else:
            a = sorted(a + joined)
        spread = (a[-1][0] if len(a) == windows else 0) - a[0][0]
        heapq.heappush(heap, (-spread, turn, a))
        turn += 1
    full = [list(w[2]) for w in heap[0][2]] if heap else []
    return full + [[] for _ in range(windows - len(full))]


def fill_windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length); every part of every item in one piece, no window over capacity."""
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    most = max(1, capacity // CUTS)
    for i, n in enumerate(sizes):
        whole, left = divmod(n, capacity)
        out += [[(i, k * capacity, capacity)] for k in range(whole)]
        parts = math.ceil(left / most)
        edges = [whole * capacity + left * k // parts for k in range(parts + 1)] if parts else []
        rest += [(i, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    rest.sort(key=lambda p: -p[2])
    lengths, total = [p[2] for p in rest], sum(p[2] for p in rest)
    few, windows = math.ceil(total / capacity) - 1, math.ceil(total / capacity)
    fits: list[list[int]] = []
    while rest and windows > few:
        dealt = difference(lengths, windows)
        mean = total / windows
        over = max(sum(lengths[k] for k in w) for w in dealt) - mean
        if mean + over <= capacity:
            # enough windows; between these and what was too few, half as many more may do
            fits, most_windows = dealt, windows
        else:
            few = windows
        if fits:
            windows = (few + most_windows) // 2
        else:
            windows = max(windows + 1, math.ceil(total / (capacity - over)) if over < capacity / 2 else 0)
    return out + [[rest[k] for k in w] for w in fits if w]


@ts.gives_back
def _pack(table: pa.Table, kind: str, capacity: int, with_ids: bool) -> pa.Table:
    ids = [x.as_py() for x in table.column("ids")]
    width = np.dtype(kind).itemsize
    order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), ids[i]))
    g = table.column("g")[0].as_py() if table.num_rows else 0
    rows: list[tuple] = []
    held: list[bytes] = []
    for k, window in enumerate(fill_windows([len(ids[i]) // width for i in order], capacity)):
        at = 0
        for item, start, n in window:
            i = order[item]
            own = np.frombuffer(ids[i], kind, n, start * width).astype("<u4")
            rows.append((i, start, n, zlib.crc32(own.tobytes()), len(ids[i]) // width, (g << 32) + k, at))
            at += n
            if with_ids:
                held.append(own.tobytes())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = {"doc_id": table.column("doc_id").combine_chunks().take(pa.array(columns[0], pa.int64()))} | {n: pa.array(c, pa.int64()) for n, c in zip(names, columns[1:], strict=True)}
    if with_ids:
        out["ids"] = pa.array(held, pa.binary())
    return pa.table(out)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on request its ids (unsigned 32-bit, little-endian)."""
    small_batches(docs.sparkSession)
    kind = "<u2" if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    docs = docs.select("doc_id", "text")
    groups = groups_for(text_bytes(docs), group_bytes)
    key = docs.schema["doc_id"].dataType.simpleString()
    ready = deal(docs, groups, group_bytes).select("doc_id", "g", "text")
    ids = ready.mapInArrow(lambda it: _tokenise(it, tokenizer_path, kind), f"doc_id {key}, g int, ids binary")
    fields = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{', ids binary' if with_ids else ''}"
    return ids.groupBy("g").applyInArrow(lambda t: _pack(t, kind, capacity, with_ids), fields)
