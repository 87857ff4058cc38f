"""Operators on small tables: the odd cases of each."""

import pytest
from pyspark.sql import functions as F

from pagestrata.operators import classify, extract, invariants, lineage, matching, policies, rollups, sequences


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


OK = "<html><title>t</title><li>"


@pytest.mark.parametrize(("url", "status", "body", "verdict", "reason"), [
    ("http://h/", 404, "", "unknown", "empty_body"), ("http://h/", 200, None, "unknown", "empty_body"), ("bad", 200, OK, "unknown", "malformed_url"),
    ("https://sec.example.com/", 200, "captcha", "challenge", None), ("https://x.sec.example.com/", 404, "x", "blocked", None), ("https://notsec.example.com/", 200, OK, "ok", None),
    ("http://h/", 404, "<title>\n Sign in </title>", "login", None), ("http://h/", 404, OK, "gone", None), ("http://h/", 403, OK, "blocked", None), ("http://h/", 429, OK, "blocked", None), ("http://h/", 418, OK, "blocked", None),
    ("http://h/", 500, OK, "unknown", "server_error"), ("http://h/", 302, OK, "unknown", "unexpected_status"), ("http://h/", None, OK, "unknown", "unexpected_status"),
    ("http://h/", 200, OK + "too many requests", "blocked", None), ("http://h/", 200, OK + "too many requests CAPTCHA", "challenge", None), ("http://h/", 200, OK + "Page not found", "soft404", None),
    ("http://h/", 200, "plain", "login", None), ("http://h/", 200, "<html", "unknown", "frame_anchors_missing"), ("http://h/", 200, OK, "ok", None),
])
def test_verdicts(spark, url, status, body, verdict, reason):
    got = classify.classify(spark.createDataFrame([(url, status, body)], "final_url string, status int, body string")).first()
    assert (got.verdict, got.verdict_reason) == (verdict, reason) and got.reasons


def test_profiles(spark):
    page = spark.createDataFrame([("http://h/a", 200, "nav-user-account one")], "final_url string, status int, body string")
    verdict = lambda **k: (lambda r: (r.verdict, r.verdict_reason))(classify.classify(page, classify.Profile(**k)).first())
    assert verdict(any_frames=("one", "two")) == ("ok", None) and verdict(frames=("one", "two")) == ("unknown", "frame_anchors_missing")
    assert verdict(any_frames=("three",)) == ("unknown", "frame_anchors_missing") and verdict(url_anchor="/b") == ("unknown", "url_drifted") and verdict(url_anchor="/a$") == ("ok", None)


def test_transitions_and_resume(spark):
    got = classify.with_transition(spark.createDataFrame([("ok",), ("login",), ("odd",)], "verdict string"))
    assert rows(got, "verdict", "state", "stop_run", "transition_reason") == [("login", "terminal_stop", True, "session_expired"), ("odd", "failed", False, "unknown_verdict"), ("ok", "done", False, None)]
    pauses = spark.createDataFrame([("crash", 0, 0), ("crash", 1, 0), ("crash", 1, None), ("quota", 0, 0), ("odd", 0, 0), (None, 0, 0)], "pause_reason string, backoff_level int, paused_at_ms long")
    got = [(r.resume, r.cooldown_ms) for r in classify.decide_resume(pauses, F.lit(1000)).collect()]
    assert got == [(True, 0), (False, 1_799_000), (True, 0), (False, 0), (False, 0), (False, 0)]


def test_item_pairs(spark):
    html = 'x<i id="1" t="a"><i id="1" t="b"><i t="c"><i id="2"><i id="3" t="d"> t="late"'
    pages = spark.createDataFrame([(1, html), (2, "none"), (3, None)], "page int, html string")
    assert rows(extract.item_pairs(pages, "page", "html", "<i", 'id="([^"]+)"', 't="([^"]+)"'), "page", "item_id", "item_time") == [(1, "1", "a"), (1, "2", None), (1, "3", "d")]
    assert rows(extract.idless_count(pages.where("page < 3"), "page", "html", "<i", 'id="([^"]+)"', 't="([^"]+)"'), "page", "idless") == [(1, 1), (2, 0)]


def test_extractors(spark):
    page = spark.createDataFrame([('<b class="c"><img src="u1"></b><img src="u2" alt="k"><img src="u2"> all (12) page 2 of 99999999999999999999',)], "h string")
    h = F.col("h")
    got = page.select(
        extract.cover_image(h, 'class="c"', 'src="([^"]+)"', "blank").alias("cover"), extract.cover_image(h, "zzz", 'src="([^"]+)"', "blank").alias("none"), extract.cover_image(h, 'class="c"', 'src="([^"]+)"', "u1").alias("placeholder"),
        extract.embedded_images(h, "<img[^>]*>", 'src="([^"]+)"', 'alt="([^"]+)"').alias("images"), extract.claimed_count(h, "(all) \\((\\d+)\\)").alias("claimed"), extract.pagination(h, "page (\\d+) of (\\d+)").alias("pages"),
        extract.strip_elements(h, "b|i", 'class="c"').alias("stripped"), extract.item_ids(h, 'src="([^"]+)"').alias("ids"),
    ).first()
    assert (got.cover.url, got.cover.reason, got.none.reason, got.placeholder.reason) == ("u1", "ok", "not_found", "placeholder")
    assert got.images == {"u1": "", "u2": "k"} and got.claimed["count"] == 12 and int(got.pages.total_pages) == 99999999999999999999
    assert got.stripped.startswith('<img src="u2"') and got.ids == ["u1", "u2"]
    with pytest.raises(ValueError):
        extract.status_photos(page, "h", "h", "a", "b", "c", "")


def test_stalls(spark):
    ids = {0: [1, 2], 1: [2, 2], 2: [1], 3: [2], 4: [9], 5: [], 6: []}
    items = spark.createDataFrame([("r", p, k, i) for p, v in ids.items() for k, i in enumerate(v or [None])], "route_key string, page int, pos int, id int")
    got = rows(sequences.stall_detection(items), "page", "new_ids", "duplicates", "barren", "empties", "stalled")
    assert got == [(0, 2, 0, 0, 0, False), (1, 0, 2, 1, 0, False), (2, 0, 1, 2, 0, False), (3, 0, 1, 3, 0, True), (4, 1, 0, 0, 0, False), (5, 0, 0, 1, 1, False), (6, 0, 0, 2, 2, True)]


def test_termination_keeps_pages_up_to_the_first_end(spark):
    pages = spark.createDataFrame([("a", k, k == 3, k == 2, k >= 5) for k in range(6)] + [("b", 0, False, False, False)], "route_key string, page int, reached_floor boolean, stalled boolean, last_page boolean")
    assert rows(sequences.route_termination(pages), "route_key", "page", "end_reason") == [("a", 0, None), ("a", 1, None), ("a", 2, "stalled"), ("b", 0, None)]


def test_watermarks_and_progress(spark):
    items = spark.createDataFrame([("r", 0, 0, 5, 50), ("r", 0, 1, 6, 10), ("r", 0, 2, 7, None), ("r", 1, 3, 8, 50), ("r", 1, 4, 5, 50), ("r", 1, 5, None, 50), ("q", 0, 0, 1, None)], "route_key string, page int, pos int, id int, ts int")
    assert rows(sequences.route_watermarks(items), "route_key", "high", "low", "high_ids") == [("r", 50, 10, [5, 8])]
    assert rows(sequences.progress_marker(items), "page", "page_median", "progress") == [(0, 50, 50), (1, 50, 50)]


def test_size_anomaly(spark):
    sizes = [100] * 8 + [20, 100]
    c = spark.createDataFrame([("r", k, n, "ok") for k, n in enumerate(sizes)] + [("r", 99, 1, "gone")], "route_key string, seq int, length int, verdict string")
    assert [r[0] for r in rows(sequences.size_anomaly(c).where("anomalous"), "seq")] == [8]


def test_frontier_next(spark):
    f = spark.createDataFrame([(1, "a", "pending", True, 2, True), (2, "b", "pending", True, 1, True), (3, "b", "failed", True, 1, True), (4, "c", "pending", False, 1, False), (5, "d", "failed", False, 1, True), (6, "d", "pending", False, 1, True), (7, "e", "pending", False, 1, True)], "seq int, route_key string, state string, ordered boolean, priority int, gate_open boolean")
    begun = spark.createDataFrame([("e",)], "route_key string")
    assert [r.seq for r in sequences.frontier_next(f, begun, 9).collect()] == [7, 6, 1]


def test_known_captures_and_items(spark):
    c = spark.createDataFrame([("k", "note.item", "ok", 1, None), ("k", "review.item", "ok", 2, 0), ("g", "note.item", "gone", 3, 4), ("l", "list", "ok", 4, None), ("a", "asset.x", None, 5, 3), ("a", "asset.x", "", 6, None)], "url_key string, route_key string, verdict string, seq int, item_count int")
    assert rows(rollups.known_captures(c), "bucket", "url_key", "route_key") == [("longform", "k", "review.item")]
    assert rows(rollups.items_by_route(c), "route_key", "items") == [("asset.x", 4), ("list", 1), ("note.item", 1), ("review.item", 0)]


def test_home_account_ties_go_to_the_first_seen(spark):
    b = spark.createDataFrame([("x", True, 0), ("y", False, 5), ("y", True, 6), ("x", True, 7), (None, False, 1), (None, False, 2), (None, False, 3)], "account_user_id string, candidate boolean, pos int")
    assert rollups.home_account(b).first().account_user_id == "y"


def test_plan_import(spark):
    c = spark.createDataFrame([(0, "a", None, False), (1, "a", None, False), (2, "b", "me", True), (3, "c", "you", False), (4, "d", "me", False), (5, "e", None, False), (6, "f", "me", False), (7, "act", "me", False), (8, "f", "me", False), (9, "c", "me", False)], "pos int, bundle_id string, account string, fatal boolean")
    existing = spark.createDataFrame([("d",), ("e",), ("f",)], "bundle_id string")
    relations = spark.createDataFrame([("d", "same"), ("e", "different"), ("f", "partial")], "bundle_id string, relation string")
    got = [r[1] for r in rows(matching.plan_import(c, existing, relations, "act", "me"), "pos", "action")]
    assert got == ["import", "duplicate", "refuse", "other_account", "present", "conflict", "resume", "active", "duplicate", "import"]


def test_compare_contents(spark):
    files = lambda *f: spark.createDataFrame([("b", *x) for x in f], "bundle_id string, name string, bytes long")
    relation = lambda s, t: (lambda r: r and r.relation)(matching.compare_contents(s, t).first())
    a = files(("x", 1), ("y", 2), ("README.txt", 9))
    assert relation(a, files(("x", 1), ("y", 2))) == "same" and relation(a, files(("x", 1))) == "partial"
    assert relation(a, files(("x", 3), ("y", 2))) == "different" and relation(a, files(("x", 1), ("z", 2))) == "different" and relation(a, files(("README.txt", 1))) is None


STATE = "route_key string, bundle_id string, pos int, high_water_time string, low_water_time string, contiguous boolean, floor_from_bundle_id string, floor_time string, gaps array<string>, advanced boolean, time_key long"


def state(spark, *r):
    return spark.createDataFrame([("r", b, p, h, h, c, f, t, [] if c else ["g"], c, -p) for b, p, h, c, f, t in r], STATE)


@pytest.mark.parametrize(("runs", "proven"), [
    ([("n", 0, "3", True, "m", "2"), ("m", 1, "2", True, None, None)], True),
    ([("n", 0, "3", True, None, None), ("m", 1, "2", False, None, None)], True),
    ([("n", 0, "3", True, "m", "2"), ("m", 1, "2", False, None, None)], False),
    ([("n", 0, "3", True, "gone", "2"), ("m", 1, "2", True, None, None)], False),
    ([("n", 0, "3", True, "m", "1"), ("m", 1, "2", True, None, None)], False),
    ([("n", 0, "3", True, "m", "2"), ("m", 1, "2", True, "n", "3")], False),
    ([("n", 0, None, True, None, None), ("m", 1, None, True, None, None)], True),
    ([("n", 0, None, True, None, None), ("m", 1, None, False, None, None)], False),
])
def test_contiguity_proof(spark, runs, proven):
    assert lineage.chain_coverage(state(spark, *runs)).first().contiguous is proven


def test_floors_come_from_advanced_runs_only(spark):
    got = lineage.pick_floors(state(spark, ("n", 0, "3", False, None, None), ("m", 1, "2", True, None, None), ("l", 2, "1", True, None, None))).first()
    assert (got.floor_from_bundle_id, got.floor_time) == ("m", "2")


def test_walks_end_at_gaps_and_cycles(spark):
    b = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 9, 5), (6, 7, 6), (7, 6, 7)], "bundle_id long, previous_bundle_id long, time_key long")
    heads = spark.createDataFrame([(4,), (5,), (7,)], "head long")
    assert rows(lineage.chain_walk(b, heads), "head", "bundle_id", "depth") == [(4, 1, 2), (4, 2, 1), (4, 4, 0), (5, 5, 0), (7, 6, 1), (7, 7, 0)]
    assert [r[0] for r in rows(lineage.chain_heads(b), "bundle_id")] == [3, 4, 5, 7]


def test_invariants(spark):
    from pagestrata.functions.digests import EMPTY_SHA256

    good = ("c", "r", "s", 0, 1, "u", "i", "k", "ok", "html", "raw", "2024-01-01T00:00:00Z", "x", None)
    bad = (None, None, "", -1, 0, None, "i", None, "odd", "x", "cooked", "2024-01-01", None, "why")
    empty = (*good[:12], EMPTY_SHA256, None)
    df = invariants.index_rules(spark.createDataFrame([good, bad, empty], "capture_id string, warc_record_id string, segment string, offset long, length long, url string, intent string, route_key string, verdict string, surface string, capture_fidelity string, observed_at string, content_sha256 string, verdict_reason string"))
    broken = [r.broken for r in df.collect()]
    assert broken[0] == [] and broken[2] == ["empty_not_ok"] and broken[1] == ["missing_capture_id", "missing_warc_record_id", "missing_url", "missing_route_key", "offset", "length", "verdict", "surface", "capture_fidelity", "observed_at", "reason_only_unknown"]
    keep, quarantined = invariants.quarantine(df)
    assert keep.count() == 1 and quarantined.count() == 2
    s = invariants.state_rules(spark.createDataFrame([(None, None, None, "full", True, True, [], "2024-01-01T00:00:00Z"), (1, None, "2024-01-01", "full", True, False, ["g"], None)], "claimed_count int, claimed_source string, floor_time string, enumeration string, advanced boolean, contiguous boolean, gaps array<string>, high_water_time string"))
    assert [r.broken for r in s.collect()] == [[], ["claim_has_source", "floor_is_bounded", "advanced_is_clean", "times_have_offset"]]
    m = invariants.manifest_rules(spark.createDataFrame([("aborted", None), ("complete", None), ("complete", "2024-01-01T00:00:00Z"), ("odd", None)], "status string, completed_at string"))
    assert [r.broken for r in m.collect()] == [[], ["completed_at"], [], ["status"]]
    assert invariants.claims_completeness(["delta", "complete"]) == ["complete"]


def test_policies(spark):
    df = spark.createDataFrame([(0, "2024-01-01", "2024-01-02", True), (None, None, None, False), (3, None, None, True)], "n int, oldest string, newest string, has boolean")
    got = [r[0] for r in df.select(policies.capture_subtitle(F.col("n"), F.col("oldest"), F.col("newest"), F.lit("2024-02-02T01:02:03Z"), F.col("has"))).collect()]
    assert got == ["0 items (the end) / 2024-01-01 to 2024-01-02", "fetched 2024-02-02T01:02:03 (no item times in this archive)", "3 items / fetched 2024-02-02T01:02:03"]
    one = spark.range(1)
    label = lambda *a: one.select(policies.contiguity_label(*map(F.lit, a)).alias("x")).first().x
    assert [label(True, False, 3), label(False, False, 3), label(False, True, 3), label(False, True, 0)] == ["verified", "in progress", "3 gaps", "not finished"]
    gaps = lambda *a: one.select(policies.gap_reasons(*map(F.lit, a)).alias("x")).first().x
    assert gaps(True, False, 5, 0) == ["no_items_observed"] and gaps(True, True, 0, 0) == ["aborted"] and gaps(True, False, 5, 2) == []
    title = one.select(policies.capture_title(F.lit("r"), F.lit("page"), F.lit(2), F.lit("s")).alias("a"), policies.capture_title(F.lit("r"), F.lit(None).cast("string"), F.lit(2), F.lit("s")).alias("b")).first()
    assert (title.a, title.b) == ("r / page 2", "r / s")
    assert one.select(policies.subject_label(F.lit("http://h/movie/12"), [("/book/(\\d+)", "book"), ("/movie/(\\d+)", "movie")]).alias("x")).first().x == "movie 12"
    assert policies.renamed_bundles(spark.createDataFrame([("b", "1", "x")], "bundle_id string, user_id string, username string"), None, "y").count() == 0
