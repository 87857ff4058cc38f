"""The corpus pipeline: its stages, and its rows against the operators' plain versions."""

import random

import corpus_pipeline
from tests.llm.test_dedup import plain_links, plain_substrings
from tests.llm.test_text_operators import plain_contamination

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(folder, spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    prose = lambda n: [word() for _ in range(n)]
    item, passage, base = prose(30), prose(60), prose(150)
    texts = [" ".join(prose(rng.randint(20, 200))) for _ in range(40)]
    texts += [" ".join(base), " ".join(base), " ".join([*base[:-1], "edited"]), " ".join(prose(20) + passage), " ".join(passage + prose(20)), " ".join(prose(10) + item + prose(9)), "too short", None, "", "same words here again now " * 9]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, " ".join(item)


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    texts, item = corpus(folder, spark)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        kept.append({r.doc_id: getattr(r, "text", None) for r in docs.collect()})
    assert set(kept[0]) == {i for i, t in enumerate(texts) if t and len(t.split()) >= 10 and "same words" not in t}
    one = plain_links(sorted(kept[0].items()))
    assert set(kept[1]) == {i for i, c, _ in one if i == c} and len(kept[1]) == len(kept[0]) - 2
    cut = {r[0]: r for r in plain_substrings(sorted(kept[1].items()))}
    assert {i: len(t.split()) for i, t in kept[2].items()} == {i: r[1] - r[2] for i, r in cut.items() if r[2] < r[1]}
    bad = plain_contamination([kept[2].get(i) for i in range(len(texts))], [(0, item)])
    assert set(kept[3]) == {i for i in kept[2] if not bad[i]} and len(kept[3]) == len(kept[2]) - 1
    assert set(kept[4]) == set(kept[3])
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids and texts, copies of one row, a text of over a million characters, and columns named like those that stages use within."""
    folder, rng = str(tmp_path), random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    same, long = prose(80), prose(200_000)
    rows = [(1, prose(60)), (2, same), (2, same), (3, same), (None, prose(50)), (None, None), (None, ""), (4, None), (5, long), (6, prose(30)), (6, prose(30)), (7, long + " end")]
    names = ["score", "kept", "own_id", "fp", "row", "g", "rank", "c0", "salt", "n_removed", "class_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", *(f"'{n}' as {n}" for n in names))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, now, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/odd{k}")
        now = spark.read.parquet(f"{folder}/odd{k}")
    assert sorted((r.doc_id for r in now.collect()), key=repr) == sorted([1, 2, 2, 5, 6, 6, None], key=repr)
    assert {r.doc_id: r.text for r in now.collect()}[5] == long
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == {1, 2, 5, 6, None}


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, columns in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
