"""Archives and URL filters."""

import base64
import gzip
import hashlib
import io

import pytest

from pagestrata.llm import urlrules, warc
from pagestrata.sources import warcfile as wf


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as first_id")


def code(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archive_round_trip(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 7}é</p>" * (k % 7)) for k in range(60)] + [(100, None, None), (101, "http://x\r\ny", ""), (None, "http://n", "<p>1é</p>"), (None, "u", "only"), (3, "again", "<p>3é</p>" * 3), (200, "big", "z" * 700_000)]
    segments = warc.write_pages(pages(spark, rows), segment_bytes=600)
    assert segments.count() > 4
    first = {}
    for i, _, html in rows:
        key = code(html)
        ids = [x for x in (first.get(key), i) if x is not None]
        first[key] = min(ids) if ids else None
    want = []
    for i, _, html in rows:
        f = first[code(html)]
        own = f is None or i == f
        want.append((i, len((html or "").encode()), code(html), "response" if own else "revisit", None if own else f))
    assert sorted((tuple(r) for r in warc.read_pages(segments).collect()), key=repr) == sorted(want, key=repr)
    none = warc.write_pages(pages(spark, []))
    assert none.count() == 0 and warc.read_pages(none).collect() == []


def test_long_headers_and_hot_payloads(spark):
    rows = [(k, "http://h/" + "x" * (2_000_000 if k == 5 else 3), "<p>same</p>" if k % 2 else f"<p>{k}</p>") for k in range(400)]
    docs = pages(spark, rows).selectExpr("*", "1 as times", "2 as salt", "3 as salts")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_pages(warc.write_pages(docs)).collect()}
    assert got == {k: ("revisit", 1) if k % 2 and k > 1 else ("response", None) for k in range(400)}


def test_reader_takes_any_chunks_and_finds_damage():
    records = [warc.page_record(k, "http://h", b"payload %d" % k * (k * 50), None if k else None, False) for k in range(5)]
    data = b"".join(wf.member(r) for r in records)
    assert gzip.decompress(data) == b"".join(records)
    for chunk in (1, 7, 100, 1 << 20):
        found = list(warc.read_records(io.BytesIO(data), keep_payload=True, chunk=chunk))
        assert [e.payload for e in found] == [b"payload %d" % k * (k * 50) for k in range(5)] and not any(e.problems for e in found)
    changed = wf.member(records[2].replace(b"payload 2", b"paYload 2", 1))
    assert set(next(warc.read_records(io.BytesIO(changed))).problems) == {"block digest", "payload digest"}
    for bad in (data[:-5], wf.member(records[1][:-3]), wf.member(records[1] + b"x"), wf.member(b"not a record\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


RULED = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("https://EXAMPLE.net/en/1?q#f", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://m.example.net/de/1", "m.example.net", "/de/1", "net/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://a.net?x", "a.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("://h/p", "h", "/p", None, "allow"),
    ("x://ÀB.Net/\n?", "Àb.net", "/\n", "net/", "block"),
]


def test_rules(spark):
    got = urlrules.judge(pages(spark, [(k, u, "") for k, (u, *_) in enumerate(RULED)] + [(None, "http://a.net/x", "")]), spark.createDataFrame([], "page_id long, bad int"))
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert rows.pop(None) == ("a.net", "/x", "net/", "block")
    assert rows == {k: tuple(r[1:]) for k, r in enumerate(RULED)}


def test_reputation_blocks_bad_hosts_and_borrows_from_domains(spark):
    rows, outcomes = [], []
    for k in range(400):
        host = ["good.com", "bad.com", "a.worse.com", "b.worse.com"][k % 4]
        rows.append((k, f"http://{host}/{k}", ""))
        outcomes.append((k, int(host != "good.com") if k % 25 else 1))
    rows += [(1000, "http://new.worse.com/", ""), (1001, "http://new.good.com/", "")]
    got = {r.page_id: r.verdict for r in urlrules.judge(pages(spark, rows), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert all(got[k] == ("allow" if k % 4 == 0 else "block") for k in range(400))
    assert got[1001] == "allow" and len(got) == 402
    assert urlrules.judge(pages(spark, []), spark.createDataFrame(outcomes, "page_id long, bad int")).collect() == []


def test_registered_domains(spark):
    hosts = {"a.example.com": ("example.com", "com"), "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "10.1.2.3": ("10.1.2.3", ""), "10.1.2.3:80": ("10.1.2.3", ""), "example.com.": ("example.com", "com"), "example.com:8080": ("example.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""), "[::1]": ("[::1]", ""), "com.de": ("com.de", "com.de"), "x.com.de": ("x.com.de", "com.de"), "xcom.de": ("xcom.de", "de")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urlrules.registered(df.host)
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def plain_poor(hosts):
    """host: (n, bad) -> hosts whose posterior bound is over the limit, by loops."""
    def unit(h, depth):
        return ".".join(h.split(".")[-depth:])

    def strength(units, mean):
        units = [(n, b) for n, b in units.values() if n]
        total = sum(n for n, _ in units)
        room = total - sum(n * n for n, _ in units) / total
        if room <= 0:
            return 1000
        v = (sum(n * (b / n - mean) ** 2 for n, b in units) - (len(units) - 1) * mean * (1 - mean)) / room
        return 1000 if v <= 0 else min(1000, max(1, mean * (1 - mean) / v - 1))

    levels = []
    for depth in (1, 2):
        found = {}
        for h, (n, b) in hosts.items():
            u = unit(h, depth)
            found[u] = tuple(map(sum, zip(found.get(u, (0, 0)), (n, b))))
        levels.append(found)
    mean = sum(b for _, b in hosts.values()) / sum(n for n, _ in hosts.values())
    s, d, k = strength(levels[0], mean), strength(levels[1], mean), strength(hosts, mean)
    out = set()
    for h, (n, b) in hosts.items():
        n0, b0 = levels[0][unit(h, 1)]
        n1, b1 = levels[1][unit(h, 2)]
        prior = (d * (s * mean + b0) / (s + n0) + b1) / (d + n1)
        x, y = k * prior + b, k * (1 - prior) + n - b
        if x / (x + y) - 1.645 * (x * y / ((x + y) ** 2 * (x + y + 1))) ** 0.5 > 0.5:
            out.add(h)
    return out


def test_posterior_equals_a_plain_version(spark):
    import random

    rng = random.Random(3)
    hosts = {}
    for d in range(40):
        poor = rng.random()
        for h in range(rng.randint(1, 5)):
            n = rng.choice([0, 1, 3, 20, 200])
            hosts[f"h{h}.d{d}.{rng.choice(['com', 'info'])}"] = (n, sum(rng.random() < poor for _ in range(n)))
    df = spark.createDataFrame([(h, n + 1, float(n), float(b)) for h, (n, b) in hosts.items()], "host string, times long, n double, bad double")
    want = plain_poor(hosts)
    assert 5 < len(want) < len(hosts) and {r.host for r in urlrules.poor_hosts(df).collect()} == want


def test_url_rules_with_repeated_rows_and_clashing_columns(spark):
    docs = pages(spark, [(1, "http://a.net/x", ""), (1, "http://a.net/x", ""), (None, None, None)]).selectExpr("*", "'x' as host", "'y' as path", "1 as poor", "2 as bad", "3 as ruling")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, bad int")
    assert sorted(map(tuple, urlrules.judge(docs, outcomes).collect()), key=repr) == sorted([(1, "a.net", "/x", "net/", "block")] * 2 + [(None, "", "", None, "allow")], key=repr)
