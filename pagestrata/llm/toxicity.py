"""Toxicity: a linear classifier over hashed character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 5 characters, lower case) of a text, hashed to ``BUCKETS``. Fitting uses at most ``FIT_ROWS``
labelled documents of each class (those with the smallest hash of doc_id), and of these, in that order, as many as fill
``FIT_FEATURES`` features; it happens in one task, whose memory those bounds hold. Scoring is one scan of all texts. The
intercept is moved from the sample's class share to the share among all labels that may be learnt from.

Defined cases: a null or empty text has no features and gets the intercept's score; a text of any length is scored whole (it is
hashed in pieces); a null doc_id has no label and isn't held out; a doc_id labelled more than once is toxic if any label says 1; of
several texts of one labelled doc_id the smallest is learnt from; repeated rows are scored one by one; without labels of both classes
the score is the share of toxic labels (0.5 without labels); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import textscan as ts
from pagestrata.llm.shared import small_batches

SIZES = (3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
FIT_ROWS = 2000
FIT_FEATURES = 1 << 25
#: Characters that are hashed at a time.
PIECE = 1 << 20
ALPHA = 1.0
#: Features seen in fewer of the sampled texts carry no weight.
LEAST_TEXTS = 3
#: Features with a log-count ratio nearer to 0 than this carry none either.
LEAST_RATIO = 0.2
PENALTY = 1e-4
STEPS = 80
RATE = 0.05
FOLDS = 5

_SEEDS = {n: np.uint64(0x9E3779B97F4A7C15 * n & ((1 << 64) - 1)) for n in SIZES}
_FACTORS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def _grams(text: str, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all n-grams of texts laid end to end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    rows = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    total = np.zeros(codes.size, np.uint64)
    for k, factor in enumerate(_FACTORS):
        m = codes.size - k
        if m <= 0:
            break
        total = total[:m] + codes[k:] * factor
        if k + 1 in SIZES:
            inside = rows[:m] == rows[k:]
            yield ts.mix(total[inside] ^ _SEEDS[k + 1]) >> np.uint64(64 - BITS), rows[:m][inside]


def features(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets, rows counted from the first) of the distinct n-grams of each row, by row, for runs of texts."""
    lo = 0
    while lo < len(texts):
        held: list[str] = []
        size = 0
        while lo + len(held) < len(texts) and (not held or size < PIECE):
            held.append((texts[lo + len(held)] or "").lower())
            size += len(held[-1])
        if len(held) == 1 and size > PIECE:
            seen = np.zeros(BUCKETS, bool)
            for at in range(0, size, PIECE):
                piece = held[0][at : at + PIECE + SIZES[-1] - 1]
                for where, _ in _grams(piece, [len(piece)]):
                    seen[where] = True
            found = np.flatnonzero(seen)
            yield lo, lo + 1, found, np.zeros(found.size, np.int64)
        else:
            keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *(where | rows << np.uint64(BITS) for where, rows in _grams("".join(held), [len(t) for t in held]))]))
            first = np.ones(keys.size, bool)
            np.not_equal(keys[1:], keys[:-1], out=first[1:])
            keys = keys[first]
            yield lo, lo + len(held), (keys & np.uint64(BUCKETS - 1)).astype(np.int64), (keys >> np.uint64(BITS)).astype(np.int64)
        lo += len(held)


def train(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], share: float) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept. Each block: buckets (int32), rows, and the labels of its rows."""
    df = [np.full(BUCKETS, ALPHA), np.full(BUCKETS, ALPHA)]
    for where, rows, y in blocks:
        for c in (0, 1):
            df[c] += np.bincount(where[y[rows] == c], minlength=BUCKETS)
    ratio = np.log(df[1] / df[1].sum()) - np.log(df[0] / df[0].sum())
    ratio[(df[0] + df[1] - 2 * ALPHA < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    blocks = [(where[used], rows[used], y) for where, rows, y in blocks for used in [ratio[where] != 0]]
    n = sum(y.size for _, _, y in blocks)
    w, b = np.zeros(BUCKETS), 0.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, STEPS + 1):
        grad, gb = PENALTY * w, 0.0
        scaled = w * ratio
        for where, rows, y in blocks:
            z = np.bincount(rows, weights=scaled[where], minlength=y.size) + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            grad += ratio * np.bincount(where, weights=err[rows], minlength=BUCKETS)
            gb += err.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    ones = sum(int(y.sum()) for _, _, y in blocks)
    b += np.log(share / (1 - share)) - np.log(ones / (n - ones))
    return (w * ratio).astype(np.float32), float(b)


@ts.gives_back
def _fit(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    blocks, used = [], 0
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        for lo, hi, where, rows in features(batch.column(0).to_pylist()):
            if used < FIT_FEATURES:
                blocks.append((where.astype(np.int32), rows.astype(np.int32), labels[lo:hi]))
                used += where.size
    if blocks:
        w, b = train(blocks, share)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["weights", "intercept"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """A model of fixed size from the labels that may be learnt from."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("label"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    none = np.zeros(BUCKETS, np.float32)
    if not 0 < ones < n:
        return none, 0.0 if n == 0 else (-20.0 if ones == 0 else 20.0)
    known = known.withColumn("turn", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("label") == c).orderBy("turn", "doc_id").limit(FIT_ROWS) for c in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "label"))  # 2 * FIT_ROWS rows at most
    sample = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label").mapInArrow(lambda it: _fit(it, ones / n), "weights binary, intercept double").collect()
    if not rows or not np.isfinite(rows[0].intercept):
        return none, float(np.log(ones / (n - ones)))
    return np.frombuffer(rows[0].weights, np.float32), rows[0].intercept


@ts.gives_back
def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, intercept: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lo, hi, where, rows in features(batch.column(2).to_pylist()):
            z = np.bincount(rows, weights=weights[where], minlength=hi - lo) + intercept
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        score = np.concatenate(out) if out else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the model is ``4 * BUCKETS`` bytes, whatever the input."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lambda it: _score(it, *model), f"doc_id {kind}, held_out boolean, score double, predicted int")
