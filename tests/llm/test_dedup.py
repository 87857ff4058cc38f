"""Substring, suffix and Jaccard operators against plain versions of their definitions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagestrata.llm import bwt, components, jaccard, substrings, suffixes
from pagestrata.llm import textscan as ts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts(seed: int, n: int = 60) -> list:
    """Texts with copies, near copies, shared passages, repeats within one, and the odd cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = prose(70), prose(300)
    texts = [" ".join(prose(rng.randint(1, 400))) for _ in range(n // 2)]
    for _ in range(n // 8):
        near = base[:]
        near[rng.randrange(300)] = "changed"
        texts.append(" ".join(near))
        texts.append("  ".join(prose(40) + passage + prose(30)) + "\n")
    texts += [" ".join(base)] * 3 + [" ".join(passage * 3), None, "", " \t\n", "one", "one", "two words", "two words", "a" * 900, "ab" * 700, "ab" * 700 + "c", "x" * 5000 + " " + "y" * 20]
    rng.shuffle(texts)
    return texts


def frame(spark, texts, ids=None, extra=False):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' as g", "1 as rank", "text as k", "2 as links") if extra else df


def plain_substrings(rows):
    lowest, words = {}, [WORDS.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            lowest[key] = min(lowest.get(key, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if lowest[tuple(w[p : p + 50])] < ((1 << 63) - 1 if i is None else i):
                gone[p : p + 50] = [True] * 50
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, y in zip(w, gone) if not y).encode()).hexdigest()))
    return sorted(out, key=repr)


def plain_suffixes(rows):
    seen = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] += 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def plain_links(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = WORDS.findall(t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n = len(rows)
    links = [[b for b in range(n) if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9] for a in range(n)]
    out = []
    for a in range(n):
        reached, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in reached:
                    reached.add(b)
                    todo.append(b)
        ids = [rows[r][0] for r in reached if rows[r][0] is not None]
        out.append((rows[a][0], min(ids) if ids else None, len(links[a])))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD_IDS = lambda n: [None if k % 17 == 3 else k // 2 for k in range(n)]


@pytest.mark.parametrize("ids", [None, ODD_IDS])
def test_substrings(spark, ids):
    texts = some_texts(1)
    ids = ids(len(texts)) if ids else None
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    assert result(substrings.removals(frame(spark, texts, ids, extra=True))) == plain_substrings(rows)


def test_substring_dedup_keeps_columns_and_untouched_texts(spark):
    texts = some_texts(2)
    docs = frame(spark, texts, extra=True).withColumnRenamed("k", "lang").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    out = substrings.dedup(docs)
    assert out.columns == docs.columns
    removed = {r[0]: r for r in plain_substrings(list(enumerate(texts)))}
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {i for i, r in removed.items() if r[2] == 0 or r[2] < r[1]}
    for i, r in rows.items():
        if removed[i][2] == 0:
            assert r.text == texts[i]
        else:
            assert hashlib.sha256(r.text.encode()).hexdigest() == removed[i][3] and r.n_chars == len(r.text)


@pytest.mark.parametrize("ids", [None, ODD_IDS])
@pytest.mark.parametrize("most", [0, 2, 4096])
def test_suffixes(spark, ids, most):
    texts = some_texts(3)
    ids = ids(len(texts)) if ids else None
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    assert result(suffixes.removals(frame(spark, texts, ids, extra=True), most_texts=most)) == plain_suffixes(rows)


def test_suffixes_in_many_shards(spark, monkeypatch):
    texts = some_texts(4)
    monkeypatch.setattr(suffixes, "SHARD_SYMBOLS", 300)
    segments = [np.frombuffer(t.encode(), np.uint8) for t in texts if t and len(t.encode()) >= 200][:25]
    rng = random.Random(4)
    text, lengths = np.concatenate(segments), np.array([s.size for s in segments])
    anchors = np.array([rng.randrange(8) for _ in segments])
    found = suffixes.repeated_starts(text, lengths, anchors)
    seen, at = defaultdict(list), 0
    for s, a in zip(segments, anchors):
        for p in range(s.size - 199):
            seen[(s[p : p + 200].tobytes(), (p - a) % 8)].append(at + p)
        at += s.size
    want = {p for v in seen.values() if len(v) > 1 for p in v}
    assert want == set(np.flatnonzero(found).tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=9), min_size=1, max_size=12), st.integers(1, 4))
def test_merged_transform_is_the_transform_of_all(strings, cut):
    parts = [strings[:cut], strings[cut:]] if strings[cut:] else [strings]
    arrays = [np.array([x for s in p for x in [*s, 0]], np.int64) for p in parts]
    source, common = bwt.merge([bwt.transform(a) for a in arrays], 12)
    rows = bwt.rows_of([bwt.transform(a) for a in arrays], source, [0, *np.cumsum([a.size for a in arrays])[:-1]])
    every = np.concatenate(arrays)
    suffix = lambda p: every[p : p + int(np.flatnonzero(every[p:] == 0)[0])].tolist()
    listed = [suffix(p) for p in rows]
    assert sorted(rows.tolist()) == list(range(every.size))
    assert listed == sorted(listed)
    for i in range(1, len(listed)):
        a, b = listed[i - 1], listed[i]
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert common[i] == k


@pytest.mark.parametrize("options", [{}, {"block_sets": 3}, {"block_shingles": 500}])
@pytest.mark.parametrize("ids", [None, ODD_IDS])
def test_links(spark, options, ids):
    texts = some_texts(5)
    ids = ids(len(texts)) if ids else None
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    assert result(jaccard.link_documents(frame(spark, texts, ids, extra=True), **options)) == plain_links(rows)


def test_one_of_each_class_stays(spark):
    texts = some_texts(6)
    want = sorted(i for i, c, _ in plain_links(list(enumerate(texts))) if i == c)
    assert sorted(r.doc_id for r in jaccard.one_of_each(frame(spark, texts)).collect()) == want


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands()
    assert bands * rows <= jaccard.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.01, 0.999, 4)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(None, 1), (5, None), (900, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("run", [substrings.removals, suffixes.removals, jaccard.link_documents, jaccard.one_of_each, substrings.dedup])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []


FAR_IDS = lambda n: [(1 << 63) - 2 - k if k % 2 else -(1 << 63) + k for k in range(n)]


@pytest.mark.parametrize("run,plain", [(substrings.removals, plain_substrings), (suffixes.removals, plain_suffixes), (jaccard.link_documents, plain_links)])
def test_ids_of_64_bits(spark, run, plain):
    texts = some_texts(8)
    ids = FAR_IDS(len(texts))
    assert result(run(frame(spark, texts, ids))) == plain(list(zip(ids, texts)))


@pytest.mark.parametrize("run,plain", [(substrings.removals, plain_substrings), (suffixes.removals, plain_suffixes)])
def test_repeated_rows_are_spread(spark, run, plain):
    texts = (some_texts(9, 16) + ["x y " * 120] * 40) * 2
    ids = [None] * len(texts)
    assert result(run(frame(spark, texts, ids), group_bytes=3000)) == plain(list(zip(ids, texts)))


@pytest.mark.parametrize("run,plain", [(substrings.removals, plain_substrings), (suffixes.removals, plain_suffixes)])
def test_very_long_texts(spark, run, plain, monkeypatch):
    rng = random.Random(10)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(420_000))
    assert len(long) > 2 * ts.SLICE_BYTES
    texts = [long, "head " + long[1_000_000:1_100_000] + " tail", long[: 1 << 20], None, "y" * 2_200_000]
    assert result(run(frame(spark, texts))) == plain(list(enumerate(texts)))


def test_links_of_very_long_texts(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(420_000)]
    texts = [" ".join(words), " ".join(words[:-9]), " ".join(words[: len(words) // 2]), "x" * 2_200_000]
    assert result(jaccard.link_documents(frame(spark, texts))) == plain_links(list(enumerate(texts)))


def test_links_of_null_and_repeated_ids(spark):
    rng = random.Random(14)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(90)]
    texts = []
    for k in range(120):
        own = base[:]
        own[rng.randrange(90)] = f"changed{k % 50}"
        texts.append(" ".join(own))
    for ids in ([None] * 120, [7] * 120):
        for options in ({}, {"block_sets": 20}):
            assert result(jaccard.link_documents(frame(spark, texts, ids), **options)) == plain_links(list(zip(ids, texts)))


def test_recall_of_links_at_the_least_similarity(spark):
    rng = random.Random(15)
    texts = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        other = words[:]
        for p in rng.sample(range(5, 199), 4):
            other[p] = "changed"
        texts += [" ".join(words), " ".join(other)]
    want = plain_links(list(enumerate(texts)))
    got = result(jaccard.link_documents(frame(spark, texts)))
    links = sum(r[2] for r in want)
    assert links > 200 and sum(r[2] for r in got) >= 0.99 * links


@pytest.mark.parametrize("run", [substrings.dedup, jaccard.one_of_each])
def test_clashing_columns_are_carried(spark, run):
    names = ["g", "rank", "row", "row_hash", "salts", "salt", "n_words", "n_removed", "kept_sha256", "c0", "id", "k", "class_id", "size"]
    docs = frame(spark, some_texts(16, 16)).selectExpr("*", *(f"'{n}' as {n}" for n in names))
    out = run(docs)
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {tuple(names)}


def test_groups_grow_with_the_root_of_the_input(spark):
    from pagestrata.llm import shared

    sizes = [shared.group_size(n) for n in (0, 1 << 30, 2 << 30, 8 << 30, 1 << 50)]
    assert sizes == [2 << 20, 2 << 20, 2 << 20, 4 << 20, 64 << 20]
    assert shared.group_size(100 << 40, 8 << 30) > 256 << 20  # executors of 8 GB a core
    assert shared.core_memory(spark) >= 0
    with pytest.raises(ValueError):
        shared.groups_for(1 << 60, 1 << 10)
