"""Segments, indexes, manifests, copies and repairs on files."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from pagestrata.session import ship
from pagestrata.sources import bundle, copying, warcfile
from pagestrata.sources.warc_format import WarcDataSource


@pytest.fixture
def archive(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"body {k} é ".encode() * (k * 20)) for k in range(40)] + [(40, None, None)]
    captures = spark.createDataFrame(rows, "seq long, url string, body binary")
    folder = str(tmp_path / "segments")
    return rows, folder, bundle.write_captures(captures, folder, str(tmp_path / "index"), lanes=2, limit=2000)


def test_records_read_back_by_index(spark, archive):
    rows, folder, index = archive
    got = {r.seq: (r.url, bytes(r.body)) for r in bundle.read_captures(index.where("seq % 3 = 1"), folder).collect()}
    assert got == {k: (u or "", b or b"") for k, u, b in rows if k % 3 == 1}
    first = index.orderBy("segment", "offset").first()
    with open(f"{folder}/{first.segment}", "rb") as f:
        assert gzip.decompress(f.read(first.offset)).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert gzip.decompress(f.read(first.length)).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    heads = bundle.segment_heads(index, folder).collect()
    assert len(heads) == index.select("segment").distinct().count() and all(h.warc_type == "warcinfo" and h.filename == h.segment and h.fields["isPartOf"].startswith("1970") for h in heads)


def test_captures_keep_all_that_they_say(spark, tmp_path):
    from datetime import datetime

    from pagestrata.operators import invariants

    columns = "seq long, url string, body binary, kind string, http_status int, status_line string, headers array<struct<name:string,value:string>>, content_type string, verdict string, intent string, route_key string, surface string, capture_fidelity string, written_at timestamp, observed_at string, item_count int, cursor struct<kind:string,value:bigint>, note string"
    rows = [(k, f"HTTP://H/{k}?b=1&a=2", b"x" * k, "assets" if k % 2 else "data", 200 + k, None if k else "HTTP/1.1 204 No", [("A", "1"), ("A", f"{k}")], "t/h", "ok", "i", "r", "html", "raw", datetime(2024, 1, 2, 3, 4, k), None if k == 3 else "2024-01-01T00:00:00+08:00", k, ("page", k), None) for k in range(9)]
    folder, bundle_id = str(tmp_path / "s"), "20240102T030405Z-00ff00"
    index = bundle.write_captures(spark.createDataFrame(rows, columns), folder, str(tmp_path / "i"), lanes=2, bundle_id=bundle_id)
    assert {tuple(r.broken) for r in invariants.index_rules(index).collect()} == {(), ("empty_not_ok",)}
    for r in index.collect():
        k = r.seq
        assert (r.capture_id, r.url, r.url_key, r.http_status, r.content_type, r.item_count, r.cursor.value, r.note) == (f"{bundle_id}#{k:06d}", f"HTTP://H/{k}?b=1&a=2", f"http://h/{k}?a=2&b=1", 200 + k, "t/h", k, k, None)
        assert r.observed_at == (f"2024-01-02T03:04:{k:02d}Z" if k == 3 else "2024-01-01T00:00:00+08:00") and r.segment.startswith("assets-" if k % 2 else "data-")
    for r in bundle.read_captures(index, folder).collect():
        own = {h.name: h.value for h in r.headers}
        assert own["WARC-Date"] == f"2024-01-02T03:04:{r.seq:02d}Z" and own["WARC-Payload-Digest"] == f"sha1:{warcfile.base32_sha1(b'x' * r.seq)}"
        assert [(h.name, h.value) for h in r.http_headers] == [("A", "1"), ("A", f"{r.seq}")] and r.status_line == ("HTTP/1.1 204 No" if r.seq == 0 else f"HTTP/1.1 {200 + r.seq}")
    files = bundle.file_digests(spark, folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "bytes", "sha256")
    segments = bundle.describe_segments(files, index)
    assert segments.agg(F.sum("record_count")).first()[0] == 9 and bundle.cross_check(segments, index).count() == 0
    about = spark.createDataFrame([(bundle_id, "complete")], "bundle_id string, status string")
    none = spark.createDataFrame([], "bundle_id string, route_key string")
    with pytest.raises(ValueError, match="count_mismatch"):
        bundle.build_manifest(about, segments.withColumn("record_count", F.col("record_count") + 1).withColumn("bundle_id", F.lit(bundle_id)), none, none, index)
    assert bundle.build_manifest(about, segments.withColumn("bundle_id", F.lit(bundle_id)), none, none, index).count() == 1
    bad = spark.createDataFrame([(1, "u", b"", [("A", "x\ny")])], "seq long, url string, body binary, headers array<struct<name:string,value:string>>")
    with pytest.raises(Exception, match="line end"):
        bundle.write_captures(bad, folder, str(tmp_path / "j"), lanes=1)


def test_segments_rotate_but_hold_at_least_one_record(archive):
    _, folder, index = archive
    sizes = index.groupBy("segment").agg(F.count("*").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert len(sizes) > 3 and all(r.end <= 2000 or r.n == 1 for r in sizes)
    assert all(os.path.getsize(f"{folder}/{r.segment}") == r.end for r in sizes)


def test_warc_data_source(spark, archive):
    rows, folder, index = archive
    spark.dataSource.register(WarcDataSource)
    got = spark.read.format("warc").option("path", folder).load()
    got = got.where("record_type = 'response'")
    assert got.count() == len(rows)
    where = {(r.path.rsplit("/", 1)[-1], r.offset, r.length) for r in got.select("path", "offset", "length").collect()}
    assert where == {(r.segment, r.offset, r.length) for r in index.collect()}
    assert {r.record_type for r in got.select("record_type").distinct().collect()} == {"response"}


def test_damage_is_planned_and_repaired(spark, archive):
    _, folder, index = archive
    segments = [r.segment for r in index.groupBy("segment").count().orderBy("segment").collect()]
    with open(f"{folder}/{segments[0]}", "ab") as f:
        f.write(b"half a record")
    with open(f"{folder}/lost.warc.gz", "wb") as f:
        f.write(b"x")
    plan = copying.repair_plan(bundle.list_files(spark, folder), index)
    assert sorted((r.name, r.action) for r in plan.collect()) == sorted([(segments[0], "truncate"), ("lost.warc.gz", "delete")])
    copying.repair(plan, folder).collect()
    assert copying.repair_plan(bundle.list_files(spark, folder), index).count() == 0
    os.truncate(f"{folder}/{segments[1]}", 3)
    assert [r.action for r in copying.repair_plan(bundle.list_files(spark, folder), index).collect()] == ["fatal"]


def test_copies_are_digested_and_resumed(spark, archive, tmp_path):
    _, folder, _ = archive
    files = bundle.list_files(spark, folder)
    target = str(tmp_path / "copy")
    first = copying.copy_files(files, folder, target).collect()
    assert {r.outcome for r in first} == {"copied"} and len(first) == files.count()
    name = first[0].name
    with open(f"{target}/{name}", "r+b") as f:
        f.write(b"!!")
    again = {r.name: r.outcome for r in copying.copy_files(files, folder, target).collect()}
    assert again.pop(name) == "copied" and set(again.values()) == {"present"}
    a, b = ({r.name: r.sha256 for r in bundle.file_digests(spark, x).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "sha256").collect()} for x in (folder, target))
    assert a == b


def test_index_lines(spark, tmp_path):
    path = tmp_path / "index-x.ndjson"
    good = json.dumps({"capture_id": "b#000001", "offset": 1, "length": 2, "cursor": {"kind": "page", "value": 3}})
    path.write_text(good + "\n" + good[:20])
    rows, broken = bundle.read_index_lenient(spark, str(path))
    assert rows.count() == 1 and broken.count() == 1 and rows.first().cursor.value == 3
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        bundle.read_index(spark, str(path)).collect()


def test_manifests_and_search(spark, tmp_path):
    for place in ("a", "a/inner", "b/c", "d/e/f/g"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "manifest.json").write_text(json.dumps({"bundle_id": place, "crawl_state": [{"route_key": "r", "contiguous": True, "gaps": []}], "coverage": [{"route_key": "r", "captured_count": 3}], "segments": [{"filename": "s", "bytes": 1}]}, indent=1))
    manifests = bundle.read_manifests(spark, f"{tmp_path}/a/manifest.json")
    assert bundle.state_table(manifests).first().contiguous and bundle.coverage_table(manifests).first().captured_count == 3 and bundle.segment_table(manifests).first().filename == "s"
    found = {r.directory.split(str(tmp_path))[-1]: r.depth for r in copying.find_bundles(spark, str(tmp_path)).collect()}
    assert found == {"/a": 1, "/b/c": 2}
    one = bundle.build_manifest(manifests.select("bundle_id", "status"), bundle.segment_table(manifests), bundle.state_table(manifests), bundle.coverage_table(manifests)).first()
    made = json.loads(one.manifest)
    assert made["bundle_id"] == "a" and made["segments"][0]["filename"] == "s" and made["crawl_state"][0]["route_key"] == "r"
    names = spark.createDataFrame([("d", "1"), ("d", "1"), ("e", "1"), ("e", "2")], "directory string, bundle_id string")
    assert [r.directory for r in bundle.identity_conflicts(names).collect()] == ["e"]


def test_record_bytes():
    block = warcfile.http_block(200, "OK", [("A", "1"), ("A", "2")], b"body\r\n\r\nmore")
    data = warcfile.record("response", "urn:uuid:x", "2024-01-01T00:00:00Z", block, "application/http")
    assert data.endswith(b"more\r\n\r\n")
    first, headers, got = warcfile.split_record(data)
    assert first == "WARC/1.1" and got == block and warcfile.first_value(headers, "warc-type") == "response"
    assert warcfile.split_http(got)[1:] == ([("A", "1"), ("A", "2")], b"body\r\n\r\nmore")
    with pytest.raises(ValueError):
        warcfile.split_record(data[:-20])
    assert b"a: b\r\n" == warcfile.fields_block([("a", "b")])
    assert ship is not None


def test_shared_folder_is_the_named_one_or_one_of_its_own(spark):
    from types import SimpleNamespace

    from pagestrata import storage

    assert storage.new_path(spark, "x").startswith(storage.shared_dir(spark) + "/pagestrata/x-")
    context = SimpleNamespace(getConf=lambda: {}, master="local[2]", applicationId="a")
    bare = SimpleNamespace(conf={}, sparkContext=context)
    assert storage.shared_dir(bare) == storage.shared_dir(bare) and storage.shared_dir(bare).startswith("file://")
    context.master = "spark://h:1"
    with pytest.raises(ValueError):
        storage.shared_dir(bare)
