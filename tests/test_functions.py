"""Scalar functions, row by row."""

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import digests, ids, text, times, urls


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("url", "key"), [
    ("HTTP://Example.COM/A/b/?b=2&a=1#f", "http://example.com/A/b/?a=1&b=2"),
    ("https://h.x/p?utm_source=q&ck=1&_spm_id=z", "https://h.x/p"),
    ("https://h.x/p?b=2&a=2&a=1", "https://h.x/p?a=2&a=1&b=2"),
    ("https://h.x", "https://h.x/"), ("https://h.x:443/a", "https://h.x/a"), ("http://h.x:8080/a", "http://h.x:8080/a"),
    ("https://h.x/?start=1&sort=t&&", "https://h.x/?sort=t&start=1"), ("https://h.x/p?q=a%20b&c=~x*", "https://h.x/p?c=%7Ex*&q=a+b"), ("https://h.x/p?q=a+b", "https://h.x/p?q=a+b"),
    ("https://h.x/?%75tm_source=1&b&a=%zz%C3%A9é", "https://h.x/?a=%25zz%C3%A9%C3%A9&b="), ("https://h.x/a/./b/../c%20d e/é\"<{", "https://h.x/a/c%20d%20e/%C3%A9%22%3C%7B"),
    ("https://h.x/a/..", "https://h.x/"), ("https://h.x/a/.", "https://h.x/a/"), ("https://u:p@H.x/", "https://u:p@h.x/"), (" https://h.x/a\tb\n ", "https://h.x/ab"), ("https://h.x/a+b!$&'()*,;=:@~|", "https://h.x/a+b!$&'()*,;=:@~|"),
    ("not a url", None), ("", None), (None, None),
])
def test_url_key(spark, url, key):
    assert one(spark, urls.url_key, url) == key
    if key:
        assert one(spark, urls.url_key, key) == key


@pytest.mark.parametrize(("url", "cursor"), [("http://h/a?p=3", 3), ("http://h/a", 1), ("http://h/a?p=x", None), ("http://h/a?q=2&p=12#f", 12)])
def test_cursor(spark, url, cursor):
    assert one(spark, lambda c: urls.cursor_from_url(c, "p", 1), url) == cursor


def test_url_predicates(spark):
    assert one(spark, lambda c: urls.with_token(c, "ck", "t"), "http://h/a?x=1") == "http://h/a?x=1&ck=t"
    assert one(spark, lambda c: urls.with_token(c, "ck", "t"), "http://h/a?ck=1") == "http://h/a?ck=1"
    assert one(spark, lambda c: urls.is_shortlink(c, ["s.x"]), "http://S.x/1") and not one(spark, lambda c: urls.is_shortlink(c, ["s.x"]), "bad")
    assert one(spark, urls.is_tracking_param, "ck") and not one(spark, urls.is_tracking_param, "CK")


def test_digests(spark):
    assert one(spark, lambda c: digests.sha1_base32(c.cast("binary")), "") == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert one(spark, digests.sha256_hex, "") == digests.EMPTY_SHA256
    assert one(spark, digests.normalize_for_digest, "é \t\r\nb 　\rc ") == "é\nb\nc"
    assert one(spark, digests.normalize_for_digest, "a \n\nb") == "a\n\nb"
    got = one(spark, digests.digest_fields, {"a": "x", "b": "y"}, "map<string,string>")
    other = one(spark, digests.digest_fields, {"a": "x", "b": "z"}, "map<string,string>")
    assert got["a"] == other["a"] and got["b"] != other["b"]


def test_ids(spark):
    b = "20240102T030405Z-00ff00"
    for seq, text_ in ((1, "000001"), (1234567, "1234567")):
        cid = one(spark, lambda c: ids.capture_id(F.lit(b), c), seq, "long")
        assert cid == f"{b}#{text_}" and one(spark, ids.capture_seq, cid) == seq and one(spark, ids.capture_bundle, cid) == b
    assert one(spark, ids.capture_seq, "x#12") is None
    assert str(one(spark, ids.bundle_time, b)) == "2024-01-02 03:04:05" and one(spark, ids.bundle_time, "x") is None
    assert one(spark, ids.bundle_of_directory, f"bundle-{b}") == b and one(spark, ids.bundle_of_directory, "bundle-x") is None
    name = one(spark, lambda c: ids.segment_filename(F.lit("data"), F.lit(b), c), 7, "int")
    assert name == f"data-{b}-00007.warc.gz" and one(spark, ids.segment_number, name) == 7 and one(spark, ids.segment_kind, name) == "data"


@pytest.mark.parametrize(("raw", "iso", "precision"), [
    ("2024-01-02 03:04:05", "2024-01-02T03:04:05+08:00", "second"), ("2024-1-2 3:04", "2024-01-02T03:04:00+08:00", "second"), ("2024-01-02T03:04:05", "2024-01-02T03:04:05+08:00", "second"),
    ("2024-01-02", "2024-01-02T00:00:00+08:00", "day"), ("2025-02-30", None, None), ("2024-13-01", None, None), ("2024-01-02 25:00", None, None), ("yesterday", None, None), (None, None, None),
])
def test_parse_naive(spark, raw, iso, precision):
    got = one(spark, times.parse_naive, raw)
    assert (got and got.iso, got and got.precision) == (iso, precision)
    if raw == "2024-01-02":
        assert got.epoch_ms == 1704124800000


def test_times(spark):
    assert [times.format_offset(m) for m in (0, 480, -210)] == ["Z", "+08:00", "-03:30"]
    for good in ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123+08:00"):
        assert one(spark, times.has_offset, good)
    assert not one(spark, times.has_offset, "2024-01-01T00:00:00") and not one(spark, times.has_offset, None)
    assert [one(spark, lambda c: times.reached_floor(c, F.lit(5)), v, "int") for v in (5, 6, None)] == [True, False, False]
    assert one(spark, lambda c: times.reached_floor(c, F.lit(None).cast("int")), 1, "int") is False
    assert [one(spark, times.backoff_ms, v, "int") for v in (0, 3, 10)] == [1000, 8000, 60000]
    assert one(spark, lambda c: times.time_key(F.lit(None).cast("string"), c), "20240102T030405Z-00ff00") == 1704164645000
    assert one(spark, lambda c: times.time_key(F.lit("2024-01-02T11:04:05+08:00"), c), "x") == 1704164645000 and one(spark, lambda c: times.time_key(c, F.lit("x")), "x") == 0


def test_text(spark):
    assert [one(spark, text.human_bytes, n, "long") for n in (0, 1023, 1024, 1536, 47257, 1 << 20, 3 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "46.1 KB", "1.0 MB", "3.00 GB"]
    assert one(spark, text.decode_entities, "&amp;lt; &nbsp;&#65;&#x42; &odd; &") == "&lt;  AB &odd; &"
    for head, image in ((b"\xff\xd8\xff" + b"0" * 9, True), (b"RIFF0000WEBP", True), (b"RIFF0000WAVE", False), (b"\x89PNG", False), (b"GIF8" + b"x" * 8, True), (None, False)):
        assert one(spark, text.looks_like_image, head, "binary") is image
