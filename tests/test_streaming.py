"""Streams give what batches give."""

import shutil

from pyspark.sql import functions as F

from pagestrata.streaming import routes

ROWS = "route_key string, kind string, page int, id long, ts long, raw string"


def run(spark, tmp_path, batches):
    source, out = tmp_path / "in", tmp_path / "out"
    shutil.rmtree(source, ignore_errors=True)
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, None)[:6] for r in rows], ROWS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(ROWS).parquet(str(source))
        put = lambda b, n, k=k: b.withColumn("k", F.lit(k)).write.mode("append").parquet(str(out))
        with routes.map_state(spark):
            routes.route_state(stream).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return {r.k: r for r in spark.read.parquet(str(out)).collect()}


def test_watermark_moves_only_after_a_clean_end(spark, tmp_path):
    got = run(spark, tmp_path, [
        [("r", "page", 0, 1, 50), ("r", "page", 0, 2, 40)],
        [("r", "gap", 1, None, None), ("r", "page", 1, 3, 60)],
        [("r", "end", 2, None, None)],
        [("r", "page", 3, 4, 55), ("r", "end", 4, None, None)],
    ])
    assert [(got[k].high_water, got[k].gaps) for k in range(4)] == [(None, 0), (None, 1), (None, 0), (55, 0)]
    assert got[0].pending_high == 50 and got[3].low_water == 40 and got[3].items == 4


def test_known_ids_are_kept_between_batches(spark, tmp_path):
    got = run(spark, tmp_path, [[("r", "page", 0, 1, None)], [("r", "page", 1, 1, None), ("r", "page", 2, 1, None)], [("r", "page", 3, 1, None)]])
    assert [got[k].stalled for k in range(3)] == [False, False, True]


def test_two_empty_pages_stall_and_unreadable_times_are_gaps(spark, tmp_path):
    got = run(spark, tmp_path, [[("r", "page", 0, 1, 5, "t"), ("r", "page", 1, None, None)], [("r", "page", 2, None, None, "soon")], [("r", "page", 3, 2, None, ""), ("r", "end", 4, None, None)]])
    assert [got[k].stalled for k in range(3)] == [False, True, True]
    assert [(got[k].gaps, got[k].high_water) for k in range(3)] == [(0, None), (1, None), (0, None)]


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = []
    for page in range(40):
        for route in "ab":
            kind = rng.choice(["page"] * 8 + ["gap", "end"])
            n = rng.choice([0, 0, 1, 3]) if kind == "page" else 1
            rows += [(route, kind, page, None if kind != "page" else rng.randrange(30), None if rng.random() < 0.3 else rng.randrange(100), rng.choice([None, "", "soon"])) for _ in range(n)] or [(route, kind, page, None, None, None)]
    cuts = [[r for r in rows if a <= r[2] < a + 10] for a in range(0, 40, 10)]
    source, out = tmp_path / "s", tmp_path / "o"
    source.mkdir()
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(source))
        put = lambda b, n, k=k: b.withColumn("k", F.lit(k)).write.mode("append").parquet(str(out))
        with routes.map_state(spark):
            routes.route_state(spark.readStream.schema(ROWS).parquet(str(source))).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(str(out)).where("k = 3").drop("k")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, routes.route_state_at_once(spark.createDataFrame(rows, ROWS)).collect()))


def test_windows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1), ("2024-01-01 10:20:00", "a", 1), ("2024-01-01 12:00:00", "a", 1), ("2024-01-02 10:00:00", "b", 2)], "t string, event_type string, user_id long").withColumn("ts", F.to_timestamp_ntz("t"))
    assert sorted((str(r.window.start), r.event_type, r.n) for r in routes.event_windows(events).collect()) == [("2024-01-01 00:00:00", "a", 3), ("2024-01-02 00:00:00", "b", 1)]
    assert sorted((r.user_id, r.n) for r in routes.session_windows(events, "user_id").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_replayed_batches_write_once(spark, tmp_path):
    source = str(tmp_path / "s")
    spark.createDataFrame([(1,), (1,), (2,)], "capture_id long").write.parquet(source)
    for _ in range(2):
        routes.write_idempotent(spark.readStream.schema("capture_id long").parquet(source), str(tmp_path / "o"), str(tmp_path / "c"), "capture_id").awaitTermination()
        shutil.rmtree(tmp_path / "c")
    assert sorted(r.capture_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2]
