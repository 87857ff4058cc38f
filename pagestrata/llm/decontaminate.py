"""Benchmark decontamination: documents that contain a benchmark item, found by item-sized windows. DataFrame functions only.

Words are the lower-cased runs of letters and digits; windows and items are compared by their five-word shingles. Windows have the
sizes of the items. A window can only be similar enough to an item of its size if enough of its shingles occur in items of that size
at all; that exact rule, which looks at sizes and not at items, spares the other windows their fingerprints (shifting a window right
to its first such shingle loses none, so windows start there). Each window gets a 64-bit SimHash, weighted by shingle counts, and
which items it is compared with is up to a multi-index: fingerprints are cut into ``BLOCKS`` blocks of 16 bits, and as one block of
two fingerprints within ``RADIUS`` must differ in at most ``RADIUS // BLOCKS`` bits, each item is listed under all such neighbours of
each of its blocks. Windows look up their own blocks, fingerprints within the radius go on, and the exact weighted Jaccard similarity
of the shingles decides.

At similarity 0.8 fingerprints differ in 9.7 of 64 bits on average with a deviation of 2.9, so the radius loses about one in 3,000
windows that are only just similar enough, and none that are much nearer.

Defined cases: a null or empty text has no words and is clean; a text shorter than an item is compared as a whole, one of any length
is searched whole; items under five words are never found; a null item_id is reported as null; rows with equal doc_id and text share
one verdict; an empty benchmark leaves every document clean, an empty table gives an empty result; extra columns are ignored by
``judge`` and carried by ``clean``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.shared import small_or_plain, written

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
RADIUS = 19
BLOCKS = 4


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(listed: Column) -> Column:
    """Hashes of the five-word shingles, in order; none for fewer words."""
    at = lambda i, k: F.get(listed, i + k)
    return F.when(F.size(listed) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(listed) - SHINGLE), lambda i: F.xxhash64(*(at(i, k) for k in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


def shingled(df: DataFrame, *carry: str | Column) -> DataFrame:
    """The ``carry`` columns and ``hashes``. Words and hashes pass through a one-row explode each: filters on them are not pushed below it, where they would be computed again."""
    listed = df.select(*carry, F.explode(F.array(words(F.col("text")))).alias("word_list"))
    kept = [c for c in listed.columns if c != "word_list"]
    return listed.select(*kept, F.explode(F.array(shingles(F.col("word_list")))).alias("hashes"))


#: How often each of four bits is set, in four lanes of 16 bits: by the value of the four bits.
LANES = [sum(((v >> k) & 1) << (16 * k) for k in range(4)) for v in range(16)]
#: Shingles that lanes can count.
LANE_ROOM = 32767


def simhash(hashes: str) -> Column:
    """The bits that more shingles of a column have than have not. Bits are counted four to a number, in one pass; one by one for lists that lanes can't count."""
    lanes = f"array({', '.join(f'{v}L' for v in LANES)})"
    quads = range(BITS // 4)
    zero = ", ".join(f"'q{k}', 0L" for k in quads)
    step = ", ".join(f"'q{k}', a.q{k} + get({lanes}, int(shiftrightunsigned(h, {4 * k}) & 15L))" for k in quads)
    mask = lambda b: f"{1 << b}L" if b < BITS - 1 else "shiftleft(1L, 63)"
    bits = " | ".join(f"if(2 * (shiftrightunsigned(c.q{b // 4}, {16 * (b % 4)}) & 65535L) > size({hashes}), {mask(b)}, 0L)" for b in range(BITS))
    fast = f"get(transform(array(aggregate({hashes}, named_struct({zero}), (a, h) -> named_struct({step}))), c -> {bits}), 0)"
    votes = f"aggregate({hashes}, 0L, (a, h) -> a + getbit(h, b))"
    slow = f"aggregate(sequence(0, {BITS - 1}), 0L, (p, b) -> p | if(2 * {votes} > size({hashes}), shiftleft(1L, b), 0L))"
    return F.expr(f"if(size({hashes}) <= {LANE_ROOM}, {fast}, {slow})")


def blocks(fingerprint: Column) -> Column:
    """The blocks of bits with their numbers."""
    wide = BITS // BLOCKS
    return F.array(*(F.struct(F.lit(k).alias("no"), F.shiftrightunsigned(fingerprint, wide * k).bitwiseAND(F.lit((1 << wide) - 1).cast("bigint")).alias("bits")) for k in range(BLOCKS)))


def neighbours(block: Column, radius: int = RADIUS) -> Column:
    """All values of a block that differ from it in ``radius // BLOCKS`` bits at most."""
    near = [x for x in range(1 << BITS // BLOCKS) if x.bit_count() <= radius // BLOCKS]
    return F.transform(F.from_json(F.lit(str(near)), "array<bigint>"), lambda x: block.bitwiseXOR(x))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of the shingles with their counts."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (a hash of the text), item, start and length in shingles, similarity: windows that hold an item."""
    items = shingled(benchmark, "item_id").where(F.size("hashes") > 0)
    items = items.select(F.struct("item_id").alias("item"), "hashes", F.size("hashes").alias("m"), F.xxhash64("hashes").alias("item_fp"))
    items = written(items, "items")
    need = F.ceil(F.col("m") * similarity - 1e-9).cast("int").alias("need")
    vocabulary = items.select("m", need, F.explode("hashes").alias("h")).distinct()

    text = shingled(docs, "doc_id", F.xxhash64("text").alias("fp"))
    spread = text.select("doc_id", "fp", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    met = spread.join(small_or_plain(vocabulary), "h")
    lists = met.groupBy("doc_id", "fp", "n", "m", "need").agg(F.sort_array(F.collect_set("pos")).alias("at")).where(F.size("at") >= F.col("need"))
    first = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.get("at", i + F.col("need") - 1) - F.get("at", i) < F.col("m"))
    starts = F.array_distinct(F.transform(first, lambda i: F.greatest(F.lit(0), F.least(F.get("at", i), F.col("n") - F.col("m")))))
    windows = lists.select("doc_id", "fp", "m", starts.alias("starts")).where(F.size("starts") > 0)
    windows = windows.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("m", "starts")).alias("windows"))
    windows = written(windows, "windows").withColumnsRenamed({"doc_id": "own_id", "fp": "own_fp"})

    held = docs.select("doc_id", "text").join(small_or_plain(windows), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.xxhash64("text") == F.col("own_fp")))
    held = shingled(held, "doc_id", F.col("own_fp").alias("fp"), "windows").dropDuplicates(["doc_id", "fp"])
    held = held.select("doc_id", "fp", "hashes", F.explode("windows").alias("w")).select("doc_id", "fp", "hashes", "w.m", F.explode("w.starts").alias("start"))
    held = held.select("doc_id", "fp", "m", "start", F.slice("hashes", F.col("start") + 1, F.col("m")).alias("part"))
    # windows of the same shingles, as leaks of one item have them, are fingerprinted and compared once
    held = written(held, "held")
    parts = held.groupBy("m", F.xxhash64("part").alias("part_fp")).agg(F.first("part").alias("part"))
    printed = written(parts.withColumn("print", simhash("part")), "prints")

    probes = printed.select("m", "part_fp", "print", F.explode(blocks(F.col("print"))).alias("block")).select("m", "part_fp", "print", "block.no", "block.bits")
    texts = written(items.groupBy("m", "item_fp").agg(F.first("hashes").alias("hashes")).withColumn("item_print", simhash("hashes")), "texts")
    index = texts.select("m", "item_fp", "item_print", F.explode(blocks(F.col("item_print"))).alias("block"))
    index = index.select("m", "item_fp", "item_print", "block.no", F.explode(neighbours(F.col("block.bits"), radius)).alias("bits"))
    # far larger than the optimizer takes it for
    near = probes.hint("merge").join(index, ["m", "no", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    pairs = near.select("m", "part_fp", "item_fp").distinct().join(printed.select("m", "part_fp", "part"), ["m", "part_fp"]).join(texts.select("m", "item_fp", "hashes"), ["m", "item_fp"])
    exact = pairs.withColumn("similarity", weighted_jaccard(F.col("part"), F.col("hashes"))).where(F.col("similarity") >= similarity - 1e-9)
    exact = exact.join(items.select("m", "item_fp", "item").distinct(), ["m", "item_fp"])
    exact = written(exact.select("m", "part_fp", "item", "similarity"), "exact")
    found = held.withColumn("part_fp", F.xxhash64("part")).join(small_or_plain(exact), ["m", "part_fp"])
    return found.select("doc_id", "fp", "item", "start", F.size("part").alias("length"), "similarity")


def _verdicts(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of docs (as one column ``row``) joined with what was found in their texts."""
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("fp"))
    found = found.withColumnsRenamed({"doc_id": "own_id", "fp": "own_fp"})
    return marked.join(small_or_plain(found), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("fp") == F.col("own_fp")), how)


def judge(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending) and similarity (the highest) of every document."""
    found = matches(docs, benchmark, similarity, radius).groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("similarity").alias("similarity"))
    kind = f"array<{benchmark.schema['item_id'].dataType.simpleString()}>"
    joined = _verdicts(docs.select("doc_id", "text"), written(found, "found"), "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce(F.col("items.item_id"), F.array().cast(kind)).alias("item_ids"), "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    found = written(matches(docs, benchmark, similarity, radius).select("doc_id", "fp").distinct(), "found")
    return _verdicts(docs, found, "left_anti").select("row.*")
