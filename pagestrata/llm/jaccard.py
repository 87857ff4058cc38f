"""N-gram Jaccard self-join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal shingle sets are one class of copies from the start. Each distinct set gets MinHash values; bands of them are
shuffled by their hash, and sets that share a band are candidates. A candidate pair is verified on the full shingle sets in the
first band that its sets share: a first pass looks at the bands alone to tell which sets have such a partner in which band, and only
those sets' shingle hashes are shipped there. Pairs are counted where they are verified, and only a spanning forest of links leaves.

A band shared by more than ``BLOCK_SETS`` sets (or ``BLOCK_SHINGLES`` shingles) would not fit a task. Sets that are connected by such
bands form a group of near copies; it is split into blocks, each pair of blocks a task of its own, and its pairs are not looked for
elsewhere. So no task holds an unbounded group and no pair list is emitted.

The result has one row a document: its class (the smallest doc_id that links reach), and how many other documents it links to
directly. Copies are not expanded into pairs; no link between different texts is left out for size.

Defined cases: doc_id is a whole number; a text under five words has its whole word sequence as its only shingle; a null or empty
text has no shingles, links to nothing and is its own class; a text of any length is one set; a null doc_id counts as the largest
number, and a class of only such documents has a null class; rows with equal doc_id are documents of their own; an empty table
gives an empty result; extra columns are ignored by ``link_documents`` and carried by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import textscan as ts
from pagestrata.llm.components import components
from pagestrata.llm.shared import small_batches, small_or_plain, spread_join, written

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
MOST_HASHES = 128
BLOCK_SETS = 2048
BLOCK_SHINGLES = 4_000_000
#: Shingles in at most this many sets of a block are paired up one by one, others by matrix products.
RARE = 12
COLUMNS = 4096
#: Sets with a candidate that are broadcast to the texts, about 300 bytes each; beyond it the texts are shuffled.
LISTED_ROWS = 200_000
#: Groups up to this size are compared pair by pair, larger ones as matrices.
FEW = 6
NO_ID = (1 << 63) - 1


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which some number of bands within ``most`` hashes reaches the recall."""
    best = None
    for rows in range(1, most + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-hit)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach that recall with so few hashes")
    return best


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, ascending by row, then hash."""
    n = offs.size - 1
    words, rows = ts.word_hashes(data, offs)
    whole = np.flatnonzero(ts.within_row(rows, SHINGLE))
    hashes, at = ts.window_hashes(words, SHINGLE)[whole], rows[whole]
    count = np.bincount(rows, minlength=n)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if short.size:
        first = np.searchsorted(rows, short)
        extra = [ts.mix(np.uint64(c) + ts.window_hashes(words[f : f + c], c))[0] for f, c in zip(first, count[short], strict=True)]
        hashes, at = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([at, short])
    order = np.lexsort((hashes, at))
    hashes, at = hashes[order], at[order]
    new = np.ones(at.size, bool)
    new[1:] = (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], at[new]


def _set_keys(hashes: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sixteen bytes by row that name its set: two sums of differently mixed hashes."""
    one = np.add.reduceat(ts.mix(hashes ^ np.uint64(0xA0761D6478BD642F)), first)
    two = np.add.reduceat(ts.mix(hashes ^ np.uint64(0xE7037ED1A0B428DB)), first)
    return np.ascontiguousarray(np.stack([one, two], 1).astype(">u8")).view("S16").ravel()


@ts.gives_back
def _signatures(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240229)
    factor = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    for batch in batches:
        for lo, hi, data, offs in ts.utf8_slices(batch.column(2)):
            hashes, at = shingles(data, offs)
            n = hi - lo
            size = np.bincount(at, minlength=n)
            have = np.flatnonzero(size)
            keys: list = [None] * n
            marks: list = [None] * n
            if have.size:
                first = np.searchsorted(at, have)
                names = _set_keys(hashes, at, first)
                out = np.empty((have.size, bands), np.uint64)
                for b in range(bands):
                    h = np.full(have.size, b + 1, np.uint64)
                    for k in range(b * rows, (b + 1) * rows):
                        h = ts.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((hashes * factor[k] + shift[k]) ^ (hashes >> np.uint64(32)), first))
                    out[:, b] = h
                for i, r in enumerate(have):
                    keys[r] = names[i].ljust(16, b"\0")
                    marks[r] = out[i].view(np.int64)
            own = [batch.column(c).slice(lo, n) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], names=["id", "fp", "k", "size", "bands"])


def _common(ha: np.ndarray, ra: np.ndarray, na: int, hb: np.ndarray, rb: np.ndarray, nb: int) -> np.ndarray:
    """How many shingles each row of one block shares with each row of another."""
    found, back = np.unique(np.concatenate([ha, hb]), return_inverse=True)
    ca, cb = back[: ha.size], back[ha.size :]
    da, db = np.bincount(ca, minlength=found.size), np.bincount(cb, minlength=found.size)
    out = np.zeros(na * nb, np.float32)
    both = (da > 0) & (db > 0)
    rare = both & (da * db <= RARE * RARE)
    # few sets: every pair of a shingle's holders, spelled out
    order = np.argsort(cb, kind="stable")
    start = np.concatenate([[0], np.cumsum(db)])
    mine = np.flatnonzero(rare[ca])
    step = 1 << 20
    for i in range(0, mine.size, step):
        part = mine[i : i + step]
        times = db[ca[part]]
        left = np.repeat(ra[part], times)
        where = np.repeat(start[ca[part]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        out += np.bincount(left * nb + rb[order[where]], minlength=out.size).astype(np.float32)
    out = out.reshape(na, nb)
    often = np.flatnonzero(both & ~rare)
    place = np.full(found.size, -1, np.int64)
    place[often] = np.arange(often.size)
    for lo in range(0, often.size, COLUMNS):
        width = min(COLUMNS, often.size - lo)
        left, right = np.zeros((na, width), np.float32), np.zeros((nb, width), np.float32)
        for matrix, c, r in ((left, place[ca], ra), (right, place[cb], rb)):
            in_ = (c >= lo) & (c < lo + width)
            matrix[r[in_], c[in_] - lo] = 1
        out += left @ right.T
    return out


def _roots(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest reachable row number of each row on both sides; right rows count after left ones unless both sides are one."""
    na, nb = link.shape
    left, right = np.arange(na), np.arange(nb) if same else np.arange(na, na + nb)
    far = na + nb
    while True:
        new_right = np.minimum(right, np.where(link, left[:, None], far).min(0, initial=far))
        new_left = np.minimum(left, np.where(link, new_right[None, :], far).min(1, initial=far))
        if same:
            new_left = new_right = np.minimum(new_left, new_right)
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


@ts.gives_back
def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by band. Those whose set has a partner for which this is the first band that they share, and not both in one large group."""
    schema = pa.schema([("k", pa.binary()), ("g", pa.int64()), ("no", pa.int32())])
    held: list[pa.RecordBatch] = []

    def judge(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        g, no = table.column("g").to_numpy(), table.column("no").to_numpy()
        large = table.column("large").to_numpy()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
        starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [n]])
        size = np.diff(starts)
        need = np.zeros(n, bool)
        two = starts[:-1][size == 2]
        same = (bands[two] == bands[two + 1]).argmax(1) == no[two]
        same &= (large[two] == 0) | (large[two] != large[two + 1])
        need[two], need[two + 1] = same, same
        for a, b in zip(starts[:-1][size > 2], starts[1:][size > 2], strict=True):
            if no[a] or large[a:b].any():
                met = _seen_before(bands[a:b], bands[a:b], int(no[a])) | _both_large(large[a:b], large[a:b])
                np.fill_diagonal(met, True)
                need[a:b] = ~met.all(1)
            else:
                need[a:b] = True
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.filter(pa.array(need)).column(x) for x in ("k", "g", "no"))], schema=schema)

    for batch in batches:
        g = batch.column(1).to_numpy()
        if not g.size:
            continue
        last = int(np.searchsorted(g, g[-1]))  # where the last band begins
        if last or (held and held[-1].column(1)[-1].as_py() != g[0]):
            yield judge(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield judge(pa.Table.from_batches(held))


def _seen_before(one: np.ndarray, two: np.ndarray, no: int) -> np.ndarray:
    """Which pairs of rows agree in a band before ``no``."""
    met = np.zeros((one.shape[0], two.shape[0]), bool)
    for k in range(no):
        met |= one[:, k][:, None] == two[:, k][None, :]
    return met


def _both_large(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one[:, None] == two[None, :]) & (one[:, None] != 0)


@ts.gives_back
def _ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each task in which a set is verified: its shingle hashes. Texts with another set than the one looked for are passed over, repeated ones of a task too."""
    schema = pa.schema([("g", pa.int64()), ("no", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("k", pa.binary()), ("copies", pa.int64()), ("large", pa.int64()), ("bands", pa.binary()), ("hashes", pa.binary())])
    seen: set[bytes] = set()
    for batch in batches:
        names = batch.column(1).to_pylist()
        for lo, _, data, offs in ts.utf8_slices(batch.column(0)):
            hashes, at = shingles(data, offs)
            have = np.unique(at)
            if not have.size:
                continue
            first = np.searchsorted(at, have)
            rows: list[tuple] = []
            for r, name, a, b in zip(have, _set_keys(hashes, at, first), first, [*first[1:], at.size], strict=True):
                want = names[lo + r]
                if name.ljust(16, b"\0") != want or want in seen:
                    continue
                seen.add(want)
                copies, large, bands, tasks = (batch.column(c)[int(lo + r)].as_py() for c in (2, 3, 4, 5))
                bands, own = np.array(bands, np.int64).tobytes(), hashes[a:b].tobytes()
                rows += [(t["g"], t["no"], t["i"], t["j"], t["block"], want, copies, large, bands, own) for t in tasks]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _verify_few(no: int, sets: list[np.ndarray], bands: np.ndarray, large: list[int], copies: list[int], names: list[bytes], similarity: float) -> list[tuple]:
    links, root = [0] * len(sets), list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x + 1, len(sets)):
            if (large[x] and large[x] == large[y]) or (bands[x, :no] == bands[y, :no]).any():
                continue
            a, b = sets[x].size, sets[y].size
            if min(a, b) < similarity * max(a, b) - 1e-6:
                continue
            both = np.intersect1d(sets[x], sets[y], assume_unique=True).size
            if both >= similarity * (a + b - both) - 1e-6:
                links[x] += copies[y]
                links[y] += copies[x]
                low, high = sorted((root[x], root[y]))
                root = [low if r == high else r for r in root]
    return [(names[x], names[root[x]], n) for x, n in enumerate(links) if n]


def _verify_many(no: int, sets: list[np.ndarray], bands: np.ndarray, large: np.ndarray, copies: np.ndarray, names: list[bytes], side: np.ndarray, similarity: float) -> list[tuple]:
    """(set, a set it is linked with or itself, links to documents of other sets) of each linked set; pairs within one side, or between two."""
    one = np.flatnonzero(side == side.min())
    two = np.flatnonzero(side != side.min())
    same = not two.size
    two = one if same else two
    size = np.array([x.size for x in sets])
    flat = lambda chosen: (np.concatenate([sets[c] for c in chosen]), np.repeat(np.arange(chosen.size), size[chosen]), chosen.size)
    common = _common(*flat(one), *flat(two))
    link = common >= similarity * (size[one][:, None] + size[two][None, :] - common) - 1e-6
    if same:
        np.fill_diagonal(link, False)
    if no >= 0:
        link &= ~(_seen_before(bands[one], bands[two], no) | _both_large(large[one], large[two]))
    left, right = _roots(link, same)
    order = np.concatenate([one, two])
    out = []
    for rows, roots, links in ((one, left, link @ copies[two]), *(() if same else ((two, right, copies[one] @ link),))):
        out += [(names[r], names[order[root]], int(n)) for r, root, n in zip(rows, roots, links, strict=True) if n]
    return out


@ts.gives_back
def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task (and set); each task's sets are compared when its last row has come. A number of -1 says that all its pairs are: those of one block of a large group, or between two."""
    schema = pa.schema([("k", pa.binary()), ("other", pa.binary()), ("links", pa.int64())])
    held: list[tuple] = []
    key = None

    def flush() -> list[tuple]:
        block, names, copies, large, bands, hashes = zip(*held, strict=True)
        _, no, i, j = key
        side = np.array(block)
        if len(held) < 2 and (no >= 0 or i == j) or (i != j and (side == side[0]).all()):
            return []
        sets = [np.frombuffer(h, np.uint64) for h in hashes]
        signs = np.stack([np.frombuffer(b, np.int64) for b in bands])
        if no >= 0 and len(held) <= FEW:
            return _verify_few(no, sets, signs, large, copies, names, similarity)
        return _verify_many(no, sets, signs, np.array(large), np.array(copies), names, side, similarity)

    rows: list[tuple] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for task, value in zip(zip(*columns[:4], strict=True), zip(*columns[4:], strict=True), strict=True):
            if task != key:
                if held:
                    rows += flush()
                held, key = [], task
            if not held or held[-1][1] != value[1]:  # repeated rows come one after another
                held.append(value)
        if len(rows) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
    if held:
        rows += flush()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _large_groups(banded: DataFrame, large: DataFrame) -> DataFrame | None:
    """k, large (the group's number), blocks and block of the sets that are connected by large bands."""
    if not large.limit(1).count():
        return None
    edges = spread_join(banded, large.select("band", "low", F.col("n").alias("times")), "band", F.xxhash64("k"))
    groups = components(edges.select(F.col("k").alias("a"), F.col("low").alias("b")))
    return groups.select(F.col("node").alias("k"), F.xxhash64("root").alias("large"))


def link_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(similarity, recall)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("fp"), "text")
    signed = written(plain.mapInArrow(lambda it: _signatures(it, bands, rows), "id long, fp long, k binary, size long, bands array<long>"), "signatures")
    sets = signed.where("k is not null").groupBy("k").agg(F.min(F.struct("id", "fp")).alias("low"), F.count("*").alias("copies"), F.max("size").alias("size"), F.min("bands").alias("bands"))
    sets = written(sets.select("k", "low.id", "low.fp", "copies", "size", "bands"), "sets")

    banded = sets.select("k", "size", F.posexplode("bands").alias("no", "band"))
    shared = written(banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("m"), F.min("k").alias("low")).where("n > 1"), "bands")
    too_large = (F.col("n") > block_sets) | (F.col("m") > block_shingles)
    hits = spread_join(banded, shared.select("band", too_large.alias("over"), F.col("n").alias("times")), "band", F.xxhash64("k"))
    listed = hits.groupBy("k").agg(F.collect_list(F.when(~F.col("over"), F.col("no"))).alias("nos"))
    groups = _large_groups(banded, shared.where(too_large))
    none = F.lit(0).cast("long")
    if groups is not None:
        groups = written(groups, "groups")
        listed = listed.join(groups, "k", "left").withColumn("large", F.coalesce("large", none))
    else:
        listed = listed.withColumn("large", none)
    candidates = written(sets.join(listed, "k"), "candidates")

    members = candidates.select("k", "bands", "large", F.explode("nos").alias("no")).select("k", F.get("bands", "no").alias("g"), "no", "large", "bands")
    tasks = members.repartition("g").sortWithinPartitions("g", "k").mapInArrow(_needed, "k binary, g long, no int")
    task = lambda g, no, i, j, block: F.struct(g.alias("g"), no.alias("no"), i.cast("int").alias("i"), j.cast("int").alias("j"), block.cast("int").alias("block"))
    zero = F.lit(0)
    tasks = tasks.select("k", task(F.col("g"), F.col("no"), zero, zero, zero).alias("task"))
    if groups is not None:
        whole = candidates.where("large <> 0").groupBy("large").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("size") / block_shingles)).alias("blocks"), F.count("*").alias("times"))
        blocked = spread_join(candidates.where("large <> 0"), written(whole, "blocks"), "large", F.xxhash64("k")).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")))
        blocked = blocked.select("k", "large", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("x"))
        tasks = tasks.unionByName(blocked.select("k", task(F.col("large"), F.lit(-1), F.least("block", "x"), F.greatest("block", "x"), F.col("block")).alias("task")))
    shipped = candidates.select("k", "id", "fp", "copies", "large", "bands").join(tasks.groupBy("k").agg(F.collect_list("task").alias("tasks")), "k")
    shipped = written(shipped, "shipped")

    texts = plain.join(small_or_plain(shipped, LISTED_ROWS), ["id", "fp"]).select("text", "k", "copies", "large", "bands", "tasks")
    dealt = texts.mapInArrow(_ship, "g long, no int, i int, j int, block int, k binary, copies long, large long, bands binary, hashes binary")
    dealt = dealt.repartition("g", "no", "i", "j").sortWithinPartitions("g", "no", "i", "j", "k")
    found = written(dealt.mapInArrow(lambda it: _verify(it, similarity), "k binary, other binary, links long"), "links")

    # only sets with links or copies say more than that a document is its own class
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("k").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "k")
    linked = written(sets.select("k", "id", "copies").join(roots, "k").join(links, "k", "left"), "linked")
    smallest = written(linked.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("times")), "classes")
    classed = spread_join(linked, smallest, "root", F.xxhash64("k")).select("k", "class_id", F.coalesce("links", none).alias("links"), "copies")
    alone = sets.where("copies > 1").join(linked.select("k"), "k", "left_anti").select("k", F.col("id").alias("class_id"), none.alias("links"), "copies")
    by_set = written(classed.unionByName(alone).select("k", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("times")), "by_set")
    out = spread_join(signed.where("k is not null").select("id", "k"), by_set, "k", F.monotonically_increasing_id(), "left").select("id", "class_id", "n_links")
    # texts without shingles have no key, by which they would all meet in one task
    out = out.unionByName(signed.where("k is null").select("id", F.col("id").alias("class_id"), none.alias("n_links")))
    real = lambda c: F.when(c != NO_ID, c).cast(kind)
    return out.select(real(F.col("id")).alias("doc_id"), real(F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("n_links", none).alias("n_links"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents without all but the smallest doc_id of each class, with their own columns. Documents without doc_id, or of equal one, all stay if their class's smallest id is theirs."""
    classes = link_documents(docs, similarity, recall).where("doc_id <> class_id").select("doc_id").distinct()
    others = small_or_plain(written(classes, "others"))
    return docs.where("doc_id is not null").join(others, "doc_id", "left_anti").select(*docs.columns).unionByName(docs.where("doc_id is null"))
