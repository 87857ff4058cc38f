"""Quality rules, toxicity, packing, decontamination and sharding against plain versions, and their odd cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagestrata.llm import decontaminate, packing, quality, sharding, toxicity
from tests.llm.test_dedup import frame, some_texts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), failed


def test_quality_counts_and_verdicts(spark):
    texts = [*some_texts(11), "a b\n\na b\n \n \nc\na b", "# $ <x> & é\u3000ü " * 4, "one two three four five " * 6]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(0, len(texts), 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.measure(frame(spark, texts, extra=True), labels)
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(t)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_scores_are_mean_log_ratios(spark):
    texts = some_texts(13)
    trusted = {i for i in range(0, len(texts), 2) if i % 3}
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int")
    grams = [(lambda w: [(x,) for x in w] + list(zip(w, w[1:])))(WORDS.findall(t or "")) for t in texts]
    raw, target = Counter(x for g in grams for x in g), Counter(x for i in trusted for x in grams[i])
    rate = sum(target.values()) / sum(raw.values())
    ratio = {x: np.log((target[x] + quality.SMOOTHING * rate) / (rate * (raw[x] + quality.SMOOTHING))) for x in raw}
    for r in quality.measure(frame(spark, texts), labels).collect():
        own = grams[r.doc_id]
        want = sum(ratio[x] for x in own) / len(own) if own else 0
        assert abs(r.score - want) < 0.002  # a few n-grams of thousands may share a bucket
        if abs(want - quality.THRESHOLD) > 0.002:
            assert r.kept == (not plain_counts(texts[r.doc_id])[-1] and want >= quality.THRESHOLD)


def test_quality_target_counts_all_labels(spark):
    """Where all documents are trusted, over 1,000,000 of them too, the target is the corpus."""
    docs = spark.range(1_000_300).selectExpr("id as doc_id", "concat('w', id % 100003, ' v') as text")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert not quality.log_ratios(docs, labels, 1 << 16).any()


@pytest.mark.parametrize("stable", [True, False])
def test_quality_of_many_labels_equals_that_of_few(spark, monkeypatch, stable):
    """Trusted rows are found by their places; where rows come in another order each time, by a join of the texts."""
    texts = some_texts(13) * 2
    ids = [None if i % 7 == 0 else i // 3 for i in range(len(texts))]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, len(texts), 2)] + [(2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts, ids).repartition(5, "text")
    few = quality.log_ratios(docs, labels, 1 << 16)

    def reordered(batches):
        for batch in batches:
            yield batch.take(np.random.default_rng().permutation(batch.num_rows))

    joins = []
    by_join = quality._sums_by_join
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(quality, "_sums_by_join", lambda *a: joins.append(1) or by_join(*a))
    many = quality.log_ratios(docs if stable else docs.coalesce(1).mapInArrow(reordered, docs.schema), labels, 1 << 16)
    assert few.any() and (many == few).all() and len(joins) == (not stable)


def test_quality_keeps_clashing_columns_and_repeated_rows(spark):
    texts = ["some plain words that go on for a while and never repeat", None, ""] * 3
    names = ["score", "kept", "n_words", "base_failed", "c0", "whole_text"]
    docs = frame(spark, texts, [1, None, 2] * 3).selectExpr("*", *(f"'{n}' as {n}" for n in names))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.filter_documents(docs, none)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, texts[0], *names)] * 3


def test_quality_of_a_very_long_text(spark):
    rng = random.Random(17)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(700_000)) + "\n" + "x" * 1_500_000 + " end #"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = quality.measure(frame(spark, [text]), none).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text)


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    texts = some_texts(12)
    assert all(r.score == 0 and r.kept != r.base_failed for r in quality.measure(frame(spark, texts), none).collect())
    assert quality.measure(frame(spark, []), none).collect() == []


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["river", "stone", "cloud", "light", "field"]) + rng.choice("abcdef") for _ in range(80)) for _ in range(150)]
    junk = [" ".join(rng.choice(["buy", "win", "now"]) + rng.choice(["!!!", "$$$", "***"]) + rng.choice("abcdef") for _ in range(80)) for _ in range(50)]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.filter_documents(frame(spark, good + junk), labels).collect()}
    assert len(kept & set(range(150))) >= 148 and not kept & set(range(150, 200))


def plain_features(text):
    """The distinct n-grams of 3 to 5 characters."""
    t = (text or "").lower()
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}


def test_toxicity_features_are_the_distinct_character_ngrams(spark, monkeypatch):
    texts = ["Straße ÀÉ Σ日本語", "aaaaaaa", "", None, "ab", "x" * 50 + "yz", "İstanbul 😀😀😀"]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        seen = {}
        for lo, hi, where, rows in toxicity.features(texts):
            for r in range(lo, hi):
                seen[r] = set(where[rows == r - lo].tolist())
        names = {}
        for r, t in enumerate(texts):
            want = plain_features(t)
            assert len(seen[r]) == len(want)  # no collisions among so few
            for g in want:
                names.setdefault(g, set()).update(seen[r])
        for g in names:  # equal n-grams share a bucket wherever they occur
            assert set.intersection(*(seen[r] for r, t in enumerate(texts) if g in plain_features(t)))


def test_toxicity_training_equals_a_plain_version():
    rng = random.Random(19)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    texts, y = [], []
    for i in range(120):
        bad = i % 3 == 0
        texts.append(" ".join(rng.choice(words) for _ in range(12)) + (" wretch" if bad else ""))
        y.append(float(bad))
    y = np.array(y)
    blocks = [(where.astype(np.int32), rows.astype(np.int32), y[lo:hi]) for lo, hi, where, rows in toxicity.features(texts)]
    weights, intercept = toxicity.train(blocks, 0.2)
    # the same by dense matrices over the n-grams themselves
    grams = sorted(set().union(*map(plain_features, texts)))
    x = np.array([[g in f for g in grams] for f in map(plain_features, texts)], float)
    counts = [toxicity.ALPHA + x[y == c].sum(0) for c in (0, 1)]
    total = [c.sum() + toxicity.ALPHA * (toxicity.BUCKETS - len(grams)) for c in counts]
    ratio = np.log(counts[1] / total[1]) - np.log(counts[0] / total[0])
    ratio[(x.sum(0) < toxicity.LEAST_TEXTS) | (np.abs(ratio) < toxicity.LEAST_RATIO)] = 0
    x = x * ratio
    w, m, v = (np.zeros(len(grams) + 1) for _ in range(3))
    x1 = np.hstack([x, np.ones((len(y), 1))])
    for step in range(1, toxicity.STEPS + 1):
        p = 1 / (1 + np.exp(-(x1 @ w)))
        grad = x1.T @ (p - y) / len(y) + toxicity.PENALTY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8 / np.sqrt(1 - 0.999**step))
    want = x @ w[:-1] + w[-1] + np.log(0.2 / 0.8) - np.log(y.sum() / (len(y) - y.sum()))
    got = np.concatenate([np.bincount(rows, weights=weights[where], minlength=hi - lo) + intercept for lo, hi, where, rows in toxicity.features(texts)])
    assert np.abs(got - want).max() < 0.03 * np.abs(want).max()  # a few n-grams share a bucket


def test_toxicity_with_repeated_rows(spark):
    texts = ["a wretch", "a friend"] * 40
    ids = [k // 4 for k in range(80)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] * 2, "doc_id long, quality int, toxic int")
    docs = frame(spark, texts, ids, extra=True).selectExpr("*", "1 as score", "2 as predicted")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert sorted(r.doc_id for r in rows) == ids and len({(r.doc_id, r.score) for r in rows}) <= 40


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    texts, labels = [], []
    for i in range(800):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 1
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["wretch", "scoundrel"]))
        texts.append(" ".join(text))
        labels.append((i, 1, int(bad)))
    docs, known = frame(spark, [*texts, None, ""]), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 800]
    assert sum(r.predicted == (r.doc_id % 5 == 1) for r in held) >= 0.97 * len(held)


def test_toxicity_does_not_see_held_out_labels(spark):
    docs = frame(spark, some_texts(8) * 3)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    seen = [(i, 1, i % 2) for i in range(100) if fold(i)]
    a = toxicity.fit(docs, spark.createDataFrame(seen + [(i, 1, 1) for i in range(100) if not fold(i)], "doc_id long, quality int, toxic int"))
    b = toxicity.fit(docs, spark.createDataFrame(seen + [(i, 1, 0) for i in range(100) if not fold(i)], "doc_id long, quality int, toxic int"))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_toxicity_with_labels_of_one_class_or_none(spark, toxic):
    rows = [] if toxic is None else [(i, 1, toxic) for i in range(20)]
    docs = frame(spark, ["a text", None])
    got = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))).collect()
    assert all(round(r.score, 3) == {None: 0.5, 0: 0.0, 1: 1.0}[toxic] for r in got)
    empty = frame(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))).collect() == []


def test_packing_round_trip(spark):
    texts = [*some_texts(9), "It's <|endoftext|> don't ½ ΑΣ 日本 ... !!", "word " * 9000]
    ids = [None if i == 4 else i for i in range(len(texts))]
    rows = packing.pack(frame(spark, texts, ids, extra=True), with_ids=True).collect()
    exact = packing.tokenizer()
    for i, t in zip(ids, texts):
        want = [*exact.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        got = []
        for r in own:
            part = np.frombuffer(r.ids, "<u4")
            assert r.start == len(got) and r.length == part.size and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
            got += part.tolist()
        assert got == want
    windows = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == windows.get(r.sequence_id, 0)
        windows[r.sequence_id] = r.offset + r.length
    total = sum(windows.values())
    assert max(windows.values()) <= packing.CAPACITY and len(windows) <= 1.02 * total / packing.CAPACITY + 2
    assert packing.pack(frame(spark, [])).collect() == []


def test_differencing_balances(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 500) for _ in range(400)]
    windows = packing.difference(sizes, 16)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400)) and max(sums) - min(sums) <= 3
    assert packing.difference([], 3) == [[], [], []] and packing.fill_windows([]) == []


def plain_difference(sizes, windows):
    """Multiway differencing as the definition says, every partition with all its windows."""
    parts = [sorted([(s, [i])] + [(0, [])] * (windows - 1), key=lambda w: -w[0]) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: -(p[0][0] - p[-1][0]))
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda w: -w[0]))
    return parts[0]


@pytest.mark.parametrize("seed", range(6))
def test_differencing_equals_the_plain_version(seed):
    rng = random.Random(seed)
    sizes = rng.sample(range(1, 100_000), 40)  # no ties, whose order is free
    for windows in (2, 3, 7, 39):
        got = sorted(sum(sizes[i] for i in w) for w in packing.difference(sizes, windows))
        assert got == sorted(w[0] for w in plain_difference(sizes, windows))


def test_windows_rise_where_capacity_is_exceeded():
    assert [sum(p[2] for p in w) for w in packing.fill_windows([4, 4, 4], 12)] == [12]
    risen = 0
    for seed in range(300):
        rng = random.Random(seed)
        sizes = [rng.randint(0, 40) for _ in range(rng.randint(1, 30))]
        windows = packing.fill_windows(sizes, 16)
        assert all(0 < sum(p[2] for p in w) <= 16 for w in windows)
        held = sorted((i, start, n) for w in windows for i, start, n in w)
        for i, size in enumerate(sizes):
            at = 0
            for _, start, n in (p for p in held if p[0] == i):
                assert start == at
                at += n
            assert at == size
        risen += len(windows) > -(-sum(sizes) // 16)
    assert risen > 10


def test_packing_sizes_groups_by_the_texts(spark):
    texts = ["word " * rng_n for rng_n in (300, 900, 20, 5, 1200, 640)] * 30
    docs = frame(spark, texts)
    plain = packing.pack(docs).select("sequence_id").distinct().count()
    joined = docs.join(docs.selectExpr("doc_id"), "doc_id").join(docs.selectExpr("doc_id"), "doc_id")
    assert packing.pack(joined).select("sequence_id").distinct().count() == plain


@pytest.mark.parametrize("text", [None, "one two three " * 40])
def test_packing_spreads_repeated_rows(spark, text):
    docs = frame(spark, [text] * 400, [None] * 400)
    rows = packing.pack(docs, group_bytes=4096).collect()
    groups = Counter(r.sequence_id >> 32 for r in rows)
    assert len(groups) > 3 and max(groups.values()) < len(rows) / 2
    assert sum(r.length for r in rows) == 400 * rows[0].doc_tokens


def test_packing_a_very_long_text(spark):
    rng = random.Random(23)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(250_000))
    rows = sorted(packing.pack(frame(spark, [text]), with_ids=True).collect(), key=lambda r: r.start)
    got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    assert got.tolist() == [*packing.tokenizer().encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_ids_of_words_equal_the_tokenizers(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ" * 2 + "éèüñßçÉÜ0123456789'!,.-#$%_*()&<|>ΣσİǺ̈—«»日\u00a0\u3000½"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    words, exact = packing.WordIds(None, "<u2"), packing.tokenizer()
    assert words.merge
    for mine, theirs in zip(words.encode([t.encode() for t in texts]), exact.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(mine, "<u2").tolist() == theirs.ids


def plain_contamination(texts, items):
    import regex

    grams = lambda t: (lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)])(regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()))
    held = {k: grams(t) for k, t in items}
    out = {}
    for i, t in enumerate(texts):
        w, hit = grams(t), []
        for k, own in held.items():
            m = len(own)
            for s in range(max(1, len(w) - m + 1)) if own and w else ():
                both = sum((Counter(w[s : s + m]) & Counter(own)).values())
                if both >= 0.8 * (len(w[s : s + m]) + m - both):
                    hit.append(k)
                    break
        out[i] = sorted(hit)
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rng.randint(14, 50)))) for k in range(12)] + [(50, "too short"), (51, None), (52, " ".join(["same"] * 20))]
    texts = []
    for k in range(60):
        text = [word() for _ in range(rng.randint(0, 120))]
        if k % 3 == 0:
            leak = items[k % 12][1].split()
            if k % 2:
                leak[rng.randrange(len(leak))] = "edited"
            text[len(text) // 2 : len(text) // 2] = leak
        texts.append(" ".join(text))
    texts += [None, "", items[3][1].upper(), items[5][1].replace(" ", ", "), " ".join(items[7][1].split()[:-1]), "same " * 40, items[2][1] * 1, texts[0]]
    docs = frame(spark, texts, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as pos")
    want = plain_contamination(texts, items)
    got = {r.doc_id: r for r in decontaminate.judge(docs, bench).collect()}
    assert {i: r.item_ids for i, r in got.items()} == want
    assert all(r.contaminated == bool(r.item_ids) == (r.similarity is not None) and r.n_items == len(r.item_ids) for r in got.values())
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [i for i, hit in want.items() if not hit]
    assert not any(r.contaminated for r in decontaminate.judge(docs, bench.where("false")).collect())
    assert decontaminate.judge(docs.where("false"), bench).collect() == []


def test_simhash_and_its_index(spark):
    rng = random.Random(8)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 9, 40, 300)] + [[7] * 5, [rng.getrandbits(64) - (1 << 63) for _ in range(9)] * 4001]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, h array<bigint>")
    def plain(x):
        bits = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in x) > len(x))
        return bits - (1 << 64) if bits >> 63 else bits
    assert [r.p for r in df.select("i", decontaminate.simhash("h").alias("p")).orderBy("i").collect()] == [plain(x) for x in lists]
    pairs = []
    for k in range(200):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), decontaminate.RADIUS if k % 2 else rng.randint(0, decontaminate.RADIUS)):
            b ^= 1 << bit
        pairs.append((k, a - (1 << 63), (b - (1 << 63))))
    df = spark.createDataFrame(pairs, "k int, a bigint, b bigint")
    left = df.selectExpr("k", "a").select("k", decontaminate.F.explode(decontaminate.blocks(decontaminate.F.col("a"))).alias("x")).select("k", "x.no", "x.bits")
    right = df.select("k", decontaminate.F.explode(decontaminate.blocks(decontaminate.F.col("b"))).alias("x")).select("k", "x.no", decontaminate.F.explode(decontaminate.neighbours(decontaminate.F.col("x.bits"))).alias("bits"))
    assert left.join(right, ["k", "no", "bits"]).select("k").distinct().count() == 200


def test_decontamination_recall_and_candidates(spark):
    """Against exact windows: edited leaks around the least similarity."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(20)]
    texts = []
    for k in range(300):
        leak = items[k % 20][1].split()
        for _ in range(k % 3):
            leak[rng.randrange(len(leak))] = "edited"
        texts.append(" ".join([word() for _ in range(20)] + leak + [word() for _ in range(20)]))
    want = plain_contamination(texts, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.judge(frame(spark, texts), bench).collect()}
    hits = [i for i, w in want.items() if w]
    assert len(hits) > 100 and all(set(got[i]) <= set(want[i]) for i in got)
    assert sum(got[i] == want[i] for i in hits) >= 0.99 * len(hits)


def test_decontamination_keeps_clashing_columns_and_repeated_rows(spark):
    item = " ".join(f"w{k}" for k in range(20))
    names = ["own_id", "own_fp", "fp", "hashes", "row", "start"]
    docs = frame(spark, [item, "clean words only here now", None, "clean words only here now", item], [1, 2, None, 2, None]).selectExpr("*", *(f"'{n}' as {n}" for n in names))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(2, "clean words only here now", *names)] * 2 + [(None, None, *names)], key=repr)
    judged = sorted(((r.doc_id, r.item_ids) for r in decontaminate.judge(docs, bench).collect()), key=repr)
    assert judged == sorted([(1, [None, 1]), (2, []), (None, []), (2, []), (None, [None, 1])], key=repr)


def plain_fill(names, slots):
    """Shards take turns, each with its whole list of preferences spelled out."""
    from hashlib import md5

    number = lambda t: int(md5(t.encode()).hexdigest()[:12], 16)
    lists = {n: [(number(f"start/{n}") + j * (number(f"step/{n}") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names}
    owner = {}
    while len(owner) < slots:
        for n in sorted(names):
            free = [s for s in lists[n] if s not in owner]
            if free:
                owner[free[0]] = n
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("names,slots", [(["a"], 7), (["b", "a", "c"], 101), ([f"s{k}" for k in range(13)], 211)])
def test_table_is_filled_in_turns(names, slots):
    assert [names[i] for i in sharding.fill(names, slots)] == plain_fill(names, slots)


def test_sharding_an_empty_table(spark):
    assert sharding.place(frame(spark, []), "doc_id").collect() == []


def test_sharding(spark):
    table = sharding.fill(["a", "b", "c"], 101)
    assert sorted(np.bincount(table)) == [33, 34, 34]
    fewer = sharding.fill(["a", "b"], 101)
    kept = (table != 2)
    assert (table[kept] == fewer[kept]).mean() > 0.7
    rows = sharding.place(frame(spark, [None] * 300, [None, *range(299)]), "doc_id").collect()
    assert len(rows) == 300 and len({r.shard for r in rows}) > 50
    from hashlib import md5

    full = sharding.fill(sharding.SHARDS)
    for r in rows:
        slot = int(md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:12], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[full[slot]])
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 100)
    with pytest.raises(ValueError):
        sharding.place(frame(spark, ["x"]).withColumnRenamed("text", "slot"), "doc_id")
