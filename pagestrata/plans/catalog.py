"""The queries by name: each applies one operator of the library to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import digests, ids, text, times, urls
from pagestrata.operators import classify, extract, invariants, lineage, matching, policies, rollups, sequences
from pagestrata.operators import routes as site_routes
from pagestrata.plans.adapters import adapt, table
from pagestrata.sources import bundle, copying
from pagestrata.storage import new_path
from pagestrata.streaming import routes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- scalar functions -------------------------------------------------------------------------------------------------


#: What is put behind every third URL, by its number: tracking, order, escapes, malformed codes, missing values, dots and odd characters.
URL_TAILS = ("", "?utm_source=a&z=1&a=2&a=1", "?q=a%20b&p=c+d&%75tm_term=x", "?e=%zz&f=%C3%A9&g=é&h=~*-._", "?flag&empty=&&=v#frag?x=1", "/a/./b/../c d/é", "/x%2Fy/<z>", "?start=1&sort=t&ck=9")


@query
def url_key(spark, d):
    tail = F.get(F.array(*(F.lit(t) for t in URL_TAILS)), (F.col("page_id") % len(URL_TAILS)).cast("int"))
    return table(spark, d, "pages").select("page_id", urls.url_key(F.concat(F.substring_index("url", "?", 1), tail)).alias("url_key"))


@query
def url_cursor(spark, d):
    return table(spark, d, "pages").select("page_id", urls.cursor_from_url(F.col("url"), "page", 1).alias("cursor"))


@query
def host_rollup(spark, d):
    return table(spark, d, "pages").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.octet_length("html")).alias("bytes"))


@query
def sha256_hex(spark, d):
    return table(spark, d, "documents").select("doc_id", digests.sha256_hex(F.col("text")).alias("sha256"))


@query
def sha1_base32(spark, d):
    return table(spark, d, "pages").select("page_id", digests.sha1_base32(F.col("html").cast("binary")).alias("digest"))


@query
def normalized_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", digests.sha256_hex(digests.normalize_for_digest(F.concat(F.col("text"), F.lit(" \t\r\nend  ")))).alias("digest"))


@query
def capture_id_roundtrip(spark, d):
    made = table(spark, d, "orders").select("o_orderkey", ids.capture_id(F.lit("20240101T000000Z-00ff00"), F.col("o_orderkey") * 97).alias("capture_id"))
    return made.select("o_orderkey", "capture_id", ids.capture_bundle(F.col("capture_id")).alias("bundle_id"), ids.capture_seq(F.col("capture_id")).alias("seq"), F.date_format(ids.bundle_time(ids.capture_bundle(F.col("capture_id"))), "yyyy-MM-dd").alias("day"))


@query
def parse_naive_ts(spark, d):
    p = times.parse_naive(F.col("raw"))
    return adapt(spark, d, "raw_times").select("event_id", p["iso"].alias("iso"), p["epoch_ms"].alias("epoch_ms"), p["precision"].alias("precision"))


@query
def backoff_schedule(spark, d):
    level = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", times.backoff_ms(level).alias("interval_ms"), times.cooldown_ms(level).alias("cooldown_ms"))


@query
def human_bytes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.human_bytes(F.expr("cast(floor(o_totalprice) as bigint) * cast(power(10.0, o_orderkey % 6) as bigint) div 100")).alias("size"))


# --- classification and extraction ------------------------------------------------------------------------------------


@query
def classify_pages(spark, d):
    return classify.classify(adapt(spark, d, "responses")).select("page_id", "verdict", "verdict_reason", "item_count")


@query
def verdict_transition(spark, d):
    rows = classify.classify(adapt(spark, d, "responses")).select("page_id", "verdict")
    return classify.with_transition(rows).select("page_id", "state", "stop_run", "transition_reason")


@query
def verdict_tally(spark, d):
    return rollups.verdict_tally(classify.classify(adapt(spark, d, "responses")))


@query
def resume_policy(spark, d):
    names = [*classify.AUTO_RESUME, *classify.NO_AUTO_RESUME, "something_else"]
    pauses = spark.createDataFrame(list(enumerate(names)), "k int, pause_reason string")
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % len(names)).cast("int").alias("k"), (F.col("o_orderkey") % 4).cast("int").alias("backoff_level"), F.lit(0).cast("long").alias("paused_at_ms"))
    out = classify.decide_resume(rows.join(F.broadcast(pauses), "k"), F.col("o_orderkey") * 1000)
    return out.select("o_orderkey", "pause_reason", "resume", "user_visible", "known_pause", "cooldown_ms")


ANCHOR, ID, TIME = "<a href=", '<a href="/?([A-Za-z]+)"', ">([A-Z][a-z]+)<"


@query
def item_pairs(spark, d):
    return extract.item_pairs(table(spark, d, "pages"), "page_id", "html", ANCHOR, ID, TIME)


@query
def item_ids(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(extract.item_ids(F.col("html"), ID), ",").alias("item_ids"))


@query
def item_count(spark, d):
    return table(spark, d, "pages").select("page_id", extract.count_matches(F.col("html"), "<li>").alias("n"))


@query
def detail_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(extract.links(F.col("html"), 'href="([^"]+)"')).alias("n_links"))


@query
def strip_comments(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(extract.strip_elements(F.col("html"), "script|style|nav", "")).alias("chars_left"))


@query
def claimed_delta(spark, d):
    rows = adapt(spark, d, "captures").groupBy("route_key", "bundle_id").agg(F.count("*").alias("captured_count"), F.max("item_count").alias("most"))
    rows = rows.withColumn("claimed_count", F.when(F.col("most") > 5, F.col("most") * 10))
    return rollups.claimed_delta(rows).select("route_key", "bundle_id", "captured_count", "claimed_count", "delta")


@query
def dq_index_rules(spark, d):
    seq = F.col("seq")
    rows = adapt(spark, d, "captures").select("capture_id", F.when(seq % 19 != 0, seq.cast("string")).alias("warc_record_id"), F.when(seq % 17 != 0, "u").alias("url"), F.when(seq % 23 != 0, F.col("intent")).alias("intent"), "route_key",
        F.when(seq % 12 == 0, "cooked").when(seq % 13 != 0, "raw").alias("capture_fidelity"), "segment", (F.col("start_at") - 50).alias("offset"), (F.col("length") % 1000).alias("length"), "verdict", F.when(F.col("seq") % 8 == 0, "other").otherwise(F.col("surface")).alias("surface"),
        F.concat("observed_at", F.when(F.col("seq") % 9 == 0, "").otherwise("T00:00:00+08:00")).alias("observed_at"), F.when(F.col("seq") % 10 == 0, digests.EMPTY_SHA256).alias("content_sha256"), F.when(F.col("seq") % 11 == 0, "x").alias("verdict_reason"))
    return invariants.index_rules(rows).select("capture_id", F.array_join("broken", ",").alias("broken"))


@query
def merge_pages(spark, d):
    pages = adapt(spark, d, "items").groupBy("route_key", "page").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    out = extract.merge_list_pages(pages, "route_key", "page", "ids")
    return out.select("route_key", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "pages_with_items")


# --- roll-ups ---------------------------------------------------------------------------------------------------------


@query
def index_counts(spark, d):
    return rollups.index_counts(adapt(spark, d, "captures"))


@query
def bundle_summary(spark, d):
    return rollups.bundle_summary(adapt(spark, d, "captures"))


@query
def items_by_route(spark, d):
    return rollups.items_by_route(adapt(spark, d, "captures"))


@query
def segment_state(spark, d):
    return rollups.segment_state(adapt(spark, d, "captures"))


@query
def segment_extents(spark, d):
    return rollups.segment_extents(adapt(spark, d, "captures").withColumnRenamed("start_at", "offset"))


@query
def segment_reconcile(spark, d):
    return rollups.segment_reconcile(adapt(spark, d, "captures"), adapt(spark, d, "segments"))


@query
def version_history(spark, d):
    out = rollups.version_history(adapt(spark, d, "captures"))
    return out.select("url_key", "versions", F.array_join(F.transform("captures", lambda c: c["capture_id"]), ",").alias("captures"))


@query
def known_captures(spark, d):
    return rollups.known_captures(adapt(spark, d, "captures"))


@query
def storage_usage(spark, d):
    return rollups.storage_usage(adapt(spark, d, "files"), "b5")


@query
def frontier_counts(spark, d):
    return rollups.frontier_counts(adapt(spark, d, "frontier"))


@query
def home_account(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("account_user_id"), (F.col("c_custkey") % 2 == 0).alias("candidate"), F.col("c_custkey").alias("pos"))
    return rollups.home_account(rows)


@query
def coverage_report(spark, d):
    state = adapt(spark, d, "state").select("bundle_id", "route_key", "contiguous", F.when(~F.col("contiguous"), 2).otherwise(0).alias("n_gaps"), F.when(F.substring("bundle_id", 4, 1) != "7", F.lit(True)).alias("finished"))
    coverage = adapt(spark, d, "state").select("bundle_id", "route_key")
    return matching.coverage_report(coverage, state).select("bundle_id", "route_key", "label", "n_gaps")


# --- joins and sets ---------------------------------------------------------------------------------------------------


@query
def repeated_captures(spark, d):
    c = adapt(spark, d, "captures")
    return matching.repeated_captures(c.where("bundle_id >= '1997'"), c.where("bundle_id < '1997'")).select("capture_id")


@query
def frontier_dedup(spark, d):
    return matching.frontier_dedup(adapt(spark, d, "frontier"), adapt(spark, d, "captures").where("verdict = 'ok'")).select("seq", "url_key")


@query
def backlog(spark, d):
    return matching.backlog(adapt(spark, d, "frontier"), adapt(spark, d, "captures").where("verdict = 'ok'"))


def _other_copy(files: DataFrame) -> DataFrame:
    """A copy with files missing, changed and added."""
    n = F.substring("bundle_id", 2, 9).cast("int")
    kept = files.where(~((n % 5 == 1) & (F.col("name") == "f2"))).withColumn("bytes", F.when((n % 7 == 2) & (F.col("name") == "f1"), F.col("bytes") + 1).otherwise(F.col("bytes")))
    return kept.where(n % 9 != 4)


@query
def compare_contents(spark, d):
    files = adapt(spark, d, "files")
    return matching.compare_contents(files, _other_copy(files))


@query
def copy_verify(spark, d):
    files = adapt(spark, d, "files").withColumn("name", F.concat_ws("/", "bundle_id", "name"))
    digest = F.when(F.col("bytes") % 4 != 0, F.sha2(F.col("bytes").cast("string"), 256))
    copy = _other_copy(adapt(spark, d, "files")).withColumn("name", F.concat_ws("/", "bundle_id", "name"))
    return matching.copy_verify(files.withColumn("sha256", digest), copy.withColumn("sha256", digest))


@query
def declared_files(spark, d):
    files = adapt(spark, d, "files")
    return matching.declared_files(files.where("name <> 'manifest.json' and name <> 'f6'"), _other_copy(files))


@query
def missing_predecessors(spark, d):
    return matching.missing_predecessors(adapt(spark, d, "bundles").where("bundle_id % 3 <> 0")).select("bundle_id", "previous_bundle_id")


@query
def plan_import(spark, d):
    files = adapt(spark, d, "files")
    here = _other_copy(files)
    candidates = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("b"), (F.col("o_orderkey") % 120).cast("string")).alias("bundle_id"), (F.col("o_orderkey") % 10).cast("string").alias("account"), (F.col("o_orderkey") % 17 == 0).alias("fatal"))
    candidates = candidates.withColumn("account", F.when(F.col("account") == "3", "other").otherwise("home"))
    existing = here.select("bundle_id").distinct().where("bundle_id <> 'b8'")
    return matching.plan_import(candidates, existing, matching.compare_contents(files, here), "b5", "home")


@query
def chain_holes(spark, d):
    return lineage.chain_holes(adapt(spark, d, "state"))


# --- ordered rows -----------------------------------------------------------------------------------------------------


@query
def stall_detection(spark, d):
    return sequences.stall_detection(adapt(spark, d, "items"))


@query
def route_termination(spark, d):
    items = adapt(spark, d, "items")
    ends = items.groupBy("route_key", "page").agg(F.coalesce(F.min("ts") <= 20, F.lit(False)).alias("reached_floor"))
    pages = sequences.stall_detection(items).join(ends, ["route_key", "page"]).withColumn("last_page", F.col("page") >= 30)
    return sequences.route_termination(pages).select("route_key", "page", "end_reason")


@query
def size_anomaly(spark, d):
    rows = adapt(spark, d, "captures").withColumn("length", F.when(F.col("seq") % 50 == 0, F.col("length") % 500).otherwise(F.col("length")))
    rows = rows.withColumn("route_key", F.concat_ws("/", "route_key", "bundle_id"))
    return sequences.size_anomaly(rows).select("capture_id", "n_before", "median_before", "anomalous")


@query
def route_watermarks(spark, d):
    out = sequences.route_watermarks(adapt(spark, d, "items"))
    return out.select("route_key", "high", "low", F.array_join(F.col("high_ids").cast("array<string>"), ",").alias("high_ids"))


@query
def item_time_range(spark, d):
    far = F.col("event_id") % 2 == 1
    at = F.timestamp_seconds(1_704_067_200 + F.floor(F.col("ts") / 10) * 60 + F.when(far, 28_800).otherwise(0))
    raw = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(far, "+08:00").otherwise("Z"))
    return sequences.item_time_range(adapt(spark, d, "items").withColumn("raw", F.when(F.col("event_id") % 11 == 0, "soon").otherwise(raw)))


@query
def progress_marker(spark, d):
    return sequences.progress_marker(adapt(spark, d, "items"))


@query
def floor_filter(spark, d):
    items = adapt(spark, d, "items")
    floors = items.groupBy("route_key").agg((F.min("ts") + 100).alias("floor")).where("route_key < 'p'")
    return sequences.floor_filter(items, floors).select("event_id", "below_floor")


@query
def event_rings(spark, d):
    rows = adapt(spark, d, "items").select("event_id", F.coalesce("ts", F.lit(0)).alias("at"), F.col("event_id").alias("seq"))
    return sequences.event_rings(rows, F.col("seq") % 3 == 0).select("event_id", "ring")


@query
def network_down(spark, d):
    return sequences.network_down(adapt(spark, d, "items"), "route_key", "pos", F.col("event_id") * 13 % 10 < 7).select("event_id", "run", "down")


@query
def capture_lineage(spark, d):
    rows = adapt(spark, d, "captures").withColumns({"parent_capture_id": F.when(F.col("seq") % 5 == 3, F.lit("given")), "no_parent": F.col("seq") % 6 == 0})
    return sequences.capture_lineage(rows.withColumn("route_key", F.concat_ws("/", "route_key", "bundle_id"))).select("capture_id", "parent")


@query
def frontier_next(spark, d):
    f = adapt(spark, d, "frontier")
    return sequences.frontier_next(f, f.where("state = 'done' and seq % 11 = 0"), 50).select("seq", "url_key")


@query
def replay_list(spark, d):
    return sequences.replay_list(adapt(spark, d, "captures"), 100, F.col("verdict") == "ok").select("capture_id")


# --- lineage ----------------------------------------------------------------------------------------------------------


@query
def pick_floors(spark, d):
    return lineage.pick_floors(adapt(spark, d, "state").withColumn("time_key", F.col("bundle_id").cast("long")))


@query
def chain_walk(spark, d):
    b = adapt(spark, d, "bundles")
    return lineage.chain_walk(b, b.where("time_key >= 2").select(F.col("bundle_id").alias("head")))


@query
def chain_heads(spark, d):
    return lineage.chain_heads(adapt(spark, d, "bundles")).select("bundle_id")


@query
def chain_coverage(spark, d):
    state = adapt(spark, d, "state").withColumn("gaps", F.when(F.col("contiguous"), F.array().cast("array<string>")).otherwise(F.array(F.lit("gap"))))
    out = lineage.chain_coverage(state)
    return out.select("route_key", "newest", "oldest", F.array_join("bundles", ",").alias("bundles"), "contiguous", "holes", F.size("gaps").alias("n_gaps"))


# --- single rows ------------------------------------------------------------------------------------------------------


@query
def asset_verdict(spark, d):
    n = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("final_url"), F.when(n % 7 == 1, 404).when(n % 7 == 2, 403).when(n % 7 == 3, 500).otherwise(200).alias("status"),
        F.when(n % 5 == 1, "text/html; charset=utf-8").when(n % 5 == 2, "image/jpeg").when(n % 5 == 3, "application/octet-stream").alias("content_type"),
        F.when(n % 4 == 1, F.lit("").cast("binary")).when(n % 4 == 2, F.unhex(F.lit("FFD8FFE000104A46494600010101"))).otherwise(F.col("html").cast("binary")).alias("content"))
    return classify.classify_asset(rows).select("page_id", "verdict", "verdict_reason")


@query
def event_routing(spark, d):
    c = adapt(spark, d, "captures").select("seq", "verdict", F.when(F.col("seq") % 3 == 0, "page").when(F.col("seq") % 5 == 0, "note").otherwise("capture").alias("type"))
    return c.select("seq", policies.should_log(F.col("type")).alias("logged"), policies.is_fetch_event(F.col("type"), F.col("verdict")).alias("routine"))


@query
def renamed_bundles(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("bundle_id"), F.col("c_nationkey").cast("string").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, "old").otherwise("new").alias("username"))
    return policies.renamed_bundles(rows, "3", "new")


@query
def prerequisites(spark, d):
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(n, F.array((n % 5).cast("string"), (n % 3).cast("string")).alias("requires"))
    left = policies.waiting_for(F.col("requires"), F.array(F.lit("1"), F.lit("4")))
    return rows.select("n_nationkey", F.array_join(left, ",").alias("waiting_for"), (F.size(left) == 0).alias("ready"))


@query
def error_classes(spark, d):
    n = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, ("AbortError", "TimeoutError", "TypeError", "QuotaExceededError", "Error"))), (n % 5 + 1).cast("int"))
    message = F.when(n % 7 == 0, "No space left").otherwise("odd")
    return table(spark, d, "orders").select(n, policies.transport_error(name, n % 2 == 0).alias("transport"), policies.write_error(name, (n % 30).cast("int"), message).alias("write"))


@query
def account_mismatch(spark, d):
    n = F.col("c_custkey")
    pick = lambda k, v: F.when(n % k != 0, F.lit(v))
    expected = [("id", pick(3, "7")), ("name", pick(4, "ann"))]
    return table(spark, d, "customer").select(n, policies.mismatch(expected, [F.when(n % 5 == 0, "8").otherwise("7"), F.when(n % 7 == 0, "bob").otherwise("ann")]).alias("mismatch"))


@query
def storage_preflight(spark, d):
    found = policies.storage_preflight(F.col("o_custkey") * 1000, F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(F.floor("o_totalprice") * 5), F.lit(300_000))
    return table(spark, d, "orders").select("o_orderkey", found["available"].alias("available"), found["enough"].alias("enough"))


@query
def nonok_tally(spark, d):
    return policies.nonok_tally(adapt(spark, d, "captures"))


@query
def gate_waits(spark, d):
    rows = adapt(spark, d, "items").withColumn("started", F.col("pos") * 700).withColumn("finished", F.col("pos") * 700 + F.col("event_id") % 500)
    return sequences.gate_waits(rows, "route_key", "pos", "started", "finished", 1000).select("event_id", "wait_ms")


@query
def idle_batches(spark, d):
    return policies.idle_batches(adapt(spark, d, "items"), "route_key", "pos", F.col("event_id") * 7 % 10 < 4).select("event_id", "idle", "stalled")


@query
def derived_captures(spark, d):
    rows = adapt(spark, d, "captures").withColumn("parent_capture_id", F.when(F.col("seq") % 3 == 1, F.concat("bundle_id", F.lit("#"), F.lpad((F.col("seq") - 1).cast("string"), 9, "0"))))
    return policies.derived_captures(rows).select("capture_id", "parent_capture_id", "parent_route")


@query
def latest_values(spark, d):
    return policies.latest_values(adapt(spark, d, "captures").select(F.col("url_key").alias("key"), F.when(F.col("seq") % 10 != 0, F.col("capture_id")).alias("value"), F.col("seq").alias("version")))


@query
def deletion_candidates(spark, d):
    c = adapt(spark, d, "captures").select("bundle_id", "route_key", F.col("url_key").alias("id"))
    runs = spark.createDataFrame([("interest.item", "full", True), ("note.item", "full", False), ("asset.cover", "bounded", True)], "route_key string, enumeration string, contiguous boolean")
    return matching.deletion_candidates(c.where("bundle_id = '1996'"), c.where("bundle_id = '1997'"), runs).distinct().select("route_key", "id")


@query
def status_photos(spark, d):
    """Two posts a row, of which one is the owner's, with a JSON list of images each."""
    n = F.col("p_partkey").cast("string")
    post = lambda owner, photos: F.concat(F.lit('<div class="post" data-uid="'), owner, F.lit('"><script>var photos = '), photos, F.lit(";</script></div>"))
    listed = F.concat(F.lit('[{"raw":"r'), n, F.lit('","large":"l"},{"large":"l'), n, F.lit('"},{}]'))
    rows = table(spark, d, "part").select("p_partkey", F.concat(post(F.when(F.col("p_partkey") % 3 == 0, "me").otherwise("you"), listed), post(F.lit("me"), F.lit('[{"raw":"z"}]'))).alias("html"))
    out = extract.status_photos(rows, "p_partkey", "html", '<div class="post"', 'data-uid="([^"]+)"', r"var photos = (\[.*?\]);", "me")
    return out.select("p_partkey", F.array_join("urls", ",").alias("urls"), "skipped_others", "unresolved")


@query
def generated_urls(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("/list/"), F.col("n_nationkey").cast("string"), F.lit("?start={offset}")).alias("template"), F.lit(0).alias("first"), (F.col("n_nationkey") * 10).cast("int").alias("last"), F.lit(15).alias("step"))
    return extract.generate_urls(rows).select("n_nationkey", "offset", "url")


# --- archives and streams ---------------------------------------------------------------------------------------------


@query
def warc_roundtrip(spark, d):
    """Pages written as segments and read back by their index."""
    folder, index_path = new_path(spark, "segments"), new_path(spark, "index")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("seq"), "url", F.col("html").cast("binary").alias("body"))
    index = bundle.write_captures(pages, folder, index_path, lanes=8, limit=1 << 22)
    read = bundle.read_captures(index, folder)
    return read.select(F.col("seq").alias("page_id"), "url", F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("sha256"))


def _in_order(spark, rows, order, parts=4):
    """A stream of files that come one after another, each with its range of ``order``. They are written one by one, as a stream takes files by age."""
    folder = new_path(spark, "stream-source")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        rows.coalesce(1).write.parquet(folder)
    else:
        width = (high - low) // parts + 1
        for k in range(parts):
            rows.where(F.col(order).between(low + k * width, low + (k + 1) * width - 1)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _ended(stream, mode, checkpoint, put=None, path=None):
    """Run a stream over all that is there."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (out.foreachBatch(put) if put else out.format("parquet").option("path", path)).start().awaitTermination()


@query
def stream_event_window(spark, d):
    """Counts by day, as the windows were when the last batch had come. Each batch's rows are a folder of files."""
    out = new_path(spark, "windows")
    put = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/part={k}")
    _ended(routes.event_windows(_in_order(spark, table(spark, d, "events"), "event_id"), late="4000 days"), "update", new_path(spark, "checkpoint"), put)
    rows = spark.read.parquet(out).groupBy("window", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query
def stream_route_state(spark, d):
    """Each route's last state, after its rows came in micro-batches."""
    rows = adapt(spark, d, "run_rows").select("route_key", "kind", "page", "id", "ts", "raw")
    out = new_path(spark, "route-state")
    put = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/part={k}")
    with routes.map_state(spark):
        _ended(routes.route_state(_in_order(spark, rows, "page")), "update", new_path(spark, "checkpoint"), put)
    states = spark.read.parquet(out)
    return states.groupBy("route_key").agg(F.max_by(F.struct("high_water", "pending_high", "low_water", "gaps", "pages", "items", "stalled"), "batch").alias("s")).select("route_key", "s.*")


@query
def stream_write_once(spark, d):
    """Events written by batches, all of them twice: as a replay would."""
    out = new_path(spark, "once")
    source = _in_order(spark, table(spark, d, "events").select("event_id", "event_type"), "event_id")
    for _ in range(2):
        routes.write_idempotent(source, out, new_path(spark, "checkpoint"), "event_id").awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type")


# --- more functions and policies --------------------------------------------------------------------------------------


@query
def url_tokens(spark, d):
    name = F.get(F.array(*(F.lit(n) for n in ("ck", "CK", "utm_source", "start"))), (F.col("page_id") % 4).cast("int"))
    url = F.when(F.col("page_id") % 7 == 0, "no url").otherwise(F.concat("url", F.when(F.col("page_id") % 3 == 0, "?ck=1").when(F.col("page_id") % 3 == 1, "?a=1").otherwise("")))
    return table(spark, d, "pages").select("page_id", urls.is_tracking_param(name).alias("tracking"), urls.with_token(url, "ck", "t").alias("with_token"), urls.is_shortlink(url, ["example.com", "example.net"]).alias("shortlink"))


@query
def digest_fields(spark, d):
    fields = digests.digest_fields(F.create_map(F.lit("text"), F.col("text"), F.lit("source"), F.col("source")))
    return table(spark, d, "documents").select("doc_id", fields["text"].alias("text"), fields["source"].alias("source"))


@query
def bundle_names(spark, d):
    made = ids.new_bundle_id(F.col("o_orderdate").cast("timestamp"), F.lpad(F.hex("o_orderkey"), 6, "0"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "odd").otherwise(F.lower(made)).alias("id")).withColumn("bundle_id", F.replace(F.replace("id", F.lit("t"), F.lit("T")), F.lit("z"), F.lit("Z")))
    b = F.col("bundle_id")
    segment = ids.segment_filename(F.when(F.col("o_orderkey") % 2 == 0, "data").otherwise("assets"), b, F.col("o_orderkey") * 50)
    return rows.select(
        "o_orderkey", "bundle_id", ids.is_bundle_id(b).alias("valid"), F.date_format(ids.bundle_time(b), "yyyy-MM-dd").alias("day"), ids.bundle_of_directory(ids.directory_name(b)).alias("from_directory"),
        ids.index_filename(b).alias("index_file"), segment.alias("segment"), ids.segment_number(segment).alias("number"), ids.segment_kind(segment).alias("kind"))


@query
def decoded_entities(spark, d):
    raw = F.concat(F.lit("&amp;lt; "), "p_name", F.lit(" &lt;&#65;&#x42;&gt; &odd; &quot;"), F.col("p_partkey").cast("string"), F.lit("&quot; & &#0;"))
    return table(spark, d, "part").select("p_partkey", text.decode_entities(raw).alias("decoded"))


@query
def capture_labels(spark, d):
    seq = F.col("seq")
    kind = F.get(F.array(F.lit("page"), F.lit("start"), F.lit(None).cast("string")), (seq % 3).cast("int"))
    at = F.when(seq % 7 != 0, F.concat(F.col("observed_at"), F.lit("T01:02:03Z")))
    rows = adapt(spark, d, "captures")
    return rows.select(
        "seq", text.short_id(F.col("capture_id")).alias("short_id"), policies.human_time(F.concat("observed_at", F.when(seq % 5 == 0, "?").otherwise(" 10:20:30"))).alias("human_time"),
        policies.capture_title(F.col("route_key"), kind, seq, F.col("url_key")).alias("title"), policies.capture_subtitle(F.col("item_count"), at, at, F.concat("observed_at", F.lit("T05:06:07+08:00")), seq % 2 == 0).alias("subtitle"),
        policies.subject_label(F.concat(F.lit("/"), F.when(seq % 2 == 0, "book").otherwise("film"), F.lit("/"), seq.cast("string")), [("/book/([0-9]+)", "Book"), ("/film/([0-9]+)", "Film")]).alias("subject"))


@query
def state_labels(spark, d):
    n = F.col("o_orderkey")
    names = spark.createDataFrame([("1-URGENT", "Urgent"), ("2-HIGH", "High"), ("5-LOW", "Low")], "o_orderpriority string, name string")
    rows = policies.with_labels(table(spark, d, "orders"), names, "o_orderpriority", "name")
    return rows.select("o_orderkey", "name", policies.contiguity_label(n % 4 == 0, n % 3 == 0, (n % 5).cast("int")).alias("contiguity"), policies.chain_headline((n % 3).cast("int")).alias("headline"))


@query
def offset_times(spark, d):
    at, n = F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 86400 + 0.25)"), F.col("o_orderkey")
    done = F.when(n % 3 == 0, times.to_rfc3339(at, 480)).when(n % 3 == 1, "yesterday")
    bundle_id = F.when(n % 2 == 0, "20240102T030405Z-00ff00").otherwise("odd")
    return table(spark, d, "orders").select("o_orderkey", times.to_rfc3339(at, 480).alias("local"), times.to_rfc3339(at, -210).alias("west"), times.warc_date(at).alias("warc_date"), times.time_key(done, bundle_id).alias("time_key"))


@query
def same_account(spark, d):
    n = F.col("c_custkey")
    user, name = F.when(n % 4 != 0, (n % 3).cast("string")), F.when(n % 5 != 0, (n % 2).cast("string"))
    return table(spark, d, "customer").select("c_custkey", *(classify.same_account(user, name, *want).alias(c) for c, want in {"both": ("1", "0"), "by_id": ("1", None), "by_name": (None, "0"), "any": (None, None)}.items()))


@query
def derives_work(spark, d):
    paged = F.when(F.col("seq") % 4 == 0, "page").when(F.col("seq") % 4 == 1, "")
    return adapt(spark, d, "captures").select("seq", policies.derives_work(F.col("route_key"), paged).alias("derives"))


def _list_page():
    n = F.col("p_partkey")
    head = F.concat(F.lit("<h1>"), "p_name", F.when(n % 5 == 0, "").when(n % 5 == 1, " (many)").otherwise(F.concat(F.lit(" ("), (n * 3).cast("string"), F.lit(")"))), F.lit("</h1>"))
    pages = F.concat(F.lit("<i>page "), (n % 4).cast("string"), F.lit(" of "), F.when(n % 7 == 0, "9223372036854775808").otherwise((n % 6).cast("string")), F.lit("</i>"))
    return F.concat(head, F.when(n % 11 == 0, "").otherwise(pages))


@query
def claimed_counts(spark, d):
    found = extract.claimed_count(_list_page(), r"<h1>([^<(]*) \(([0-9]+|many)\)</h1>")
    return table(spark, d, "part").select("p_partkey", found["count"].alias("claimed"), found["raw"].alias("raw"))


@query
def paginations(spark, d):
    found = extract.pagination(_list_page(), "<i>page ([0-9]+) of ([0-9]+)</i>")
    return table(spark, d, "part").select("p_partkey", found["page"].cast("string").alias("page"), found["total_pages"].cast("string").alias("total_pages"))


@query
def cover_images(spark, d):
    n = F.col("p_partkey")
    img = F.concat(F.lit('<img src="'), F.when(n % 3 == 0, "default.png").otherwise(F.concat(F.lit("c"), n.cast("string"))), F.lit('">'))
    html = F.concat(F.lit('<img src="logo">'), F.when(n % 5 == 0, "").otherwise('<div id="cover">'), F.repeat(F.lit("x"), (n % 4 * 300).cast("int")), img)
    found = extract.cover_image(html, '<div id="cover">', 'src="([^"]+)"', "default")
    return table(spark, d, "part").select("p_partkey", found["url"].alias("url"), found["reason"].alias("reason"))


@query
def embedded_images(spark, d):
    n = F.col("p_partkey").cast("string")
    figure = lambda u, c: F.concat(F.lit('<figure><img src="'), u, F.lit('">'), F.when(c.isNotNull(), F.concat(F.lit("<p>"), c, F.lit("</p>"))).otherwise(""), F.lit("</figure>"))
    html = F.concat(figure(n, F.col("p_name")), figure(F.lit("b"), F.lit(None).cast("string")), figure(n, F.lit("again")), F.lit("<figure>none</figure>"))
    found = extract.embedded_images(html, "<figure>.*?</figure>", 'src="([^"]+)"', "<p>([^<]*)</p>")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.map_keys(found), ",").alias("urls"), F.array_join(F.map_values(found), ",").alias("captions"))


@query
def render_sample(spark, d):
    sample = extract.render_sample(adapt(spark, d, "captures"), "route_key", "seq")
    return extract.sample_failures(sample, "route_key", F.when(F.col("seq") % 5 != 0, F.col("verdict") != "ok"))


@query
def extracted_rows(spark, d):
    """Rows of an extractor, as JSON text and read again by their schema."""
    from pagestrata import schemas

    made = F.to_json(F.struct(F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, "2024-01-01").alias("date"), F.array(F.col("p_name"), F.lit("t")).alias("tags"), F.lit(1).alias("other")))
    mark = F.from_json(F.when(F.col("p_partkey") % 7 == 0, "{").otherwise(made), schemas.MARK)
    return table(spark, d, "part").select("p_partkey", mark["title"].alias("title"), mark["date"].alias("date"), F.size(mark["tags"]).alias("n_tags"), mark["comment"].alias("comment"))


@query
def verification(spark, d):
    checks = matching.declared_files(adapt(spark, d, "files"), _other_copy(adapt(spark, d, "files"))).select(F.col("code").alias("problem"))
    return rollups.verification(checks.unionByName(adapt(spark, d, "files").select(F.lit(None).cast("string").alias("problem"))))


@query
def export_state(spark, d):
    exported = table(spark, d, "nation").select(F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("bundle_id"), F.lit("2024-01-01").alias("exported_at"))
    return rollups.export_state(rollups.storage_usage(adapt(spark, d, "files")), exported).select("bundle_id", "export_state")


@query
def bundle_sizes(spark, d):
    c = adapt(spark, d, "captures")
    declared = c.where("bundle_id < '1995'").groupBy("bundle_id", "segment").agg((F.max(F.col("start_at") + F.col("length"))).alias("bytes"))
    return rollups.bundle_sizes(c, declared)


@query
def segment_numbers(spark, d):
    name = F.concat(F.when(F.col("seq") % 2 == 0, "data").otherwise("assets"), F.lit("-"), "bundle_id", F.lit("-"), F.lpad((F.col("seq") % 300).cast("string"), 5, "0"), F.when(F.col("seq") % 7 == 0, ".warc").otherwise(".warc.gz"))
    return rollups.segment_numbers(adapt(spark, d, "captures").withColumn("segment", name))


@query
def page_floors(spark, d):
    items = adapt(spark, d, "items").withColumn("raw", F.when(F.col("event_id") % 18 == 0, "soon").when(F.col("event_id") % 9 == 0, ""))
    floors = adapt(spark, d, "items").groupBy("route_key").agg((F.min("ts") + 50).alias("floor")).where("length(route_key) % 2 = 0")
    return sequences.page_floors(items, floors)


@query
def replay_truncated(spark, d):
    return sequences.replay_truncated(adapt(spark, d, "captures"), 100, F.col("verdict") == "ok")


@query
def opened_gates(spark, d):
    """The queue whose items wait for another route, and which of them may go."""
    rows = adapt(spark, d, "frontier").drop("gate_open").withColumn("gated_by", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("r"), (F.col("seq") % 40).cast("string"))))
    state = rows.select("route_key").distinct().withColumn("can_advance", F.substring("route_key", 2, 2).cast("int") % 2 == 0)
    gates = sequences.open_gates(rows.where("state <> 'pending' or route_key not in ('r2', 'r4', 'r6')"), state)
    return sequences.gated(rows, gates).select("seq", "gate_open")


@query
def within_budget(spark, d):
    rows = adapt(spark, d, "items").withColumn("took", F.col("event_id") % 5000)
    return policies.within_budget(rows, "route_key", "pos", "took", 22_000).select("event_id", "spent_ms")


@query
def list_limits(spark, d):
    """What reports show: captures, unlike ones, and routes."""
    c = adapt(spark, d, "captures")
    shown = [policies.listed(c.select(F.lit("rows").alias("what"), F.col("capture_id").alias("name")), "rows", "name"), policies.listed(c.where("verdict <> 'ok'").select(F.lit("bad_rows").alias("what"), F.col("capture_id").alias("name")), "bad_rows", "name"),
             policies.listed(adapt(spark, d, "frontier").select(F.lit("routes").alias("what"), F.col("route_key").alias("name")).distinct(), "routes", "name")]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query
def import_totals(spark, d):
    sizes = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.floor("o_totalprice").alias("bytes"))
    return matching.import_totals(plan_import(spark, d), sizes)


@query
def route_order(spark, d):
    return site_routes.in_order(site_routes.route_table(spark)).select("turn", "key", "intent", "kind", "surface", "enumeration", "ordered")


@query
def seeded_frontier(spark, d):
    seeds = site_routes.seed_frontier(site_routes.route_table(spark), "example.com", "some one")
    return seeds.select("route_key", "url", "url_key", "ordered", "priority", F.col("cursor.kind").alias("cursor_kind"), F.col("cursor.value").alias("cursor_value"))


# --- files ------------------------------------------------------------------------------------------------------------


BUNDLE = "20240102T030405Z-00ff00"


def _captures(spark, d):
    """Pages as captures that say all they can."""
    n = F.col("page_id")
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    return table(spark, d, "pages").select(
        n.alias("seq"), "url", F.col("html").cast("binary").alias("body"), F.when(n % 4 == 0, "assets").otherwise("data").alias("kind"), (200 + n % 3).cast("int").alias("http_status"),
        F.array(pair("Content-Type", F.lit("text/html")), pair("X-Id", n.cast("string")), pair("X-Id", F.lit("again"))).alias("headers"), F.lit("text/html").alias("content_type"),
        F.when(n % 5 == 0, "gone").otherwise("ok").alias("verdict"), F.lit("page").alias("intent"), F.concat(F.lit("r"), (n % 3).cast("string")).alias("route_key"), F.lit("html").alias("surface"),
        F.lit("decoded_body+observed_headers").alias("capture_fidelity"), F.timestamp_seconds(1_700_000_000 + n).alias("written_at"), (n % 20).cast("int").alias("item_count"), F.struct(F.lit("page").alias("kind"), n.alias("value")).alias("cursor"))


def _written(spark, d, lanes=4):
    folder, index_path = new_path(spark, "segments"), new_path(spark, "index")
    return folder, index_path, bundle.write_captures(_captures(spark, d), folder, index_path, lanes, limit=1 << 22, bundle_id=BUNDLE)


@query
def capture_write(spark, d):
    """What captures say, read back from the index and from the records."""
    folder, _, index = _written(spark, d)
    value = lambda column, name: F.array_join(F.transform(F.filter(column, lambda h: h["name"] == name), lambda h: h["value"]), ",")
    read = bundle.read_captures(index, folder).select("seq", value(F.col("headers"), "WARC-Date").alias("warc_date"), value(F.col("headers"), "WARC-Payload-Digest").alias("payload_digest"), "status_line", value(F.col("http_headers"), "X-Id").alias("x_id"), F.octet_length("body").alias("bytes"))
    ruled = invariants.index_rules(index).withColumn("broken", F.array_join("broken", ","))
    kept = ruled.select("seq", "capture_id", "url", "url_key_rules", "intent", "route_key", "verdict", "capture_fidelity", "observed_at", "http_status", "content_type", "content_sha256", "item_count", F.col("cursor.value").alias("cursor_value"), ids.segment_kind(F.col("segment")).alias("kind"), "broken")
    return kept.join(read, "seq")


@query
def segment_heads(spark, d):
    folder, _, index = _written(spark, d)
    heads = bundle.segment_heads(index, folder).withColumn("kind", ids.segment_kind(F.col("segment")))
    return heads.select("kind", "warc_type", (F.col("filename") == F.col("segment")).alias("named"), F.col("fields")["isPartOf"].alias("part_of"), F.col("fields")["format"].alias("format")).distinct()


@query
def segment_descriptors(spark, d):
    """Of each kind of segments: their records, and whether files, digests and index agree. Segments are one lane's."""
    folder, _, index = _written(spark, d, lanes=1)
    files = bundle.file_digests(spark, folder).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    found = bundle.describe_segments(files.select("name", "bytes", "sha256"), index)
    ends = rollups.segment_extents(index).withColumnRenamed("segment", "filename")
    both = found.join(ends, "filename").withColumn("kind", ids.segment_kind(F.col("filename")))
    return both.groupBy("kind").agg(F.sum("record_count").alias("records"), F.min("first_capture_id").alias("first_capture_id"), F.max("last_capture_id").alias("last_capture_id"), F.min((F.col("bytes") == F.col("extent")) & (F.length("sha256") == 64)).alias("whole"))


@query
def index_recount(spark, d):
    """Counts of an index read from its files, strictly, and leniently with a line that is cut short in each."""
    _, index_path, _ = _written(spark, d)
    strict = rollups.index_counts(bundle.read_index(spark, index_path)).withColumn("reading", F.lit("strict"))
    torn = new_path(spark, "torn")
    lines = spark.read.text(index_path)
    lines.unionByName(lines.where("value like '%\"gone\"%'").select(F.substring("value", 1, 40).alias("value"))).write.text(torn)
    good, broken = bundle.read_index_lenient(spark, torn)
    lenient = rollups.index_counts(good).withColumn("reading", F.lit("lenient"))
    lost = broken.agg(F.lit("broken").alias("dimension"), F.lit("lines").alias("value"), F.count("*").alias("n")).withColumn("reading", F.lit("lenient"))
    return strict.unionByName(lenient).unionByName(lost)


@query
def manifest_roundtrip(spark, d):
    """Manifests of bundles, built, written, and their segments and state read back."""
    c = adapt(spark, d, "captures").withColumnRenamed("start_at", "offset").withColumn("segment", F.concat_ws("-", "bundle_id", "segment"))
    segments = rollups.segment_state(c).withColumnRenamed("segment", "filename").withColumnRenamed("records", "record_count").withColumn("bundle_id", ids.capture_bundle(F.col("first_capture_id")))
    state = adapt(spark, d, "state").select("bundle_id", "route_key", "high_water_time", "contiguous", "advanced")
    about = c.select("bundle_id").distinct().withColumn("status", F.lit("complete")).withColumn("completed_at", F.concat("bundle_id", F.lit("-12-31T00:00:00Z")))
    made = bundle.build_manifest(about, segments, state, state.select("bundle_id", "route_key").distinct(), c)
    path = new_path(spark, "manifests")
    made.repartition("bundle_id").select(F.col("manifest").alias("value"), F.col("bundle_id").alias("b")).write.partitionBy("b").text(path)
    read = bundle.read_manifests(spark, path)
    seg = bundle.segment_table(read).groupBy("bundle_id").agg(F.count("*").alias("segments"), F.sum("record_count").alias("records"), F.min("first_capture_id").alias("first_capture_id"))
    runs = bundle.state_table(read).groupBy("bundle_id").agg(F.count("*").alias("runs"), F.sum(F.col("contiguous").cast("int")).alias("contiguous"))
    listed = bundle.coverage_table(read).groupBy("bundle_id").agg(F.count("*").alias("covered"))
    broken = invariants.manifest_rules(read.select("bundle_id", "status", "completed_at")).select("bundle_id", F.size("broken").alias("broken"))
    return seg.join(runs, "bundle_id").join(listed, "bundle_id").join(broken, "bundle_id")


@query
def manifest_cross_check(spark, d):
    return bundle.cross_check(adapt(spark, d, "segments"), adapt(spark, d, "captures"))


@query
def recovery_plan(spark, d):
    """Segments with bytes after their index, segments that no row points at, and segments that are too short."""
    index = adapt(spark, d, "captures").withColumnRenamed("start_at", "offset").withColumn("segment", F.concat("segment", F.lit(".warc.gz")))
    n = F.substring("name", 6, 1).cast("int")
    files = rollups.segment_extents(index).select(F.col("segment").alias("name"), F.col("extent").alias("bytes")).withColumn("bytes", F.col("bytes") + F.when(n == 1, 5).when(n == 2, -1).otherwise(0))
    return copying.repair_plan(files.unionByName(files.where(n == 3).select(F.lit("lost.warc.gz").alias("name"), "bytes")), index)


@query
def bundle_discovery(spark, d):
    """Directories with a manifest, a few levels deep, found again. One directory a nation of the first ten."""
    root = new_path(spark, "bundles")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in (r.n_nationkey for r in table(spark, d, "nation").where("n_nationkey < 10").select("n_nationkey").collect()):
        place = "/".join([f"d{k}"] * (k % 5 + 1))
        for name in ("manifest.json", "inner/index-x.ndjson"):
            out = files.create(hadoop.Path(f"{root}/{place}/{name}"))
            out.write(10)
            out.close()
    found = copying.find_bundles(spark, root)
    return found.select(F.regexp_extract("directory", "/(d[0-9]+(/d[0-9]+)*)$", 1).alias("directory"), "depth")


@query
def identity_conflicts(spark, d):
    names = table(spark, d, "orders").select(F.concat(F.lit("d"), (F.col("o_orderkey") % 500).cast("string")).alias("directory"), F.when(F.col("o_orderkey") % 1700 == 0, "other").otherwise((F.col("o_orderkey") % 500).cast("string")).alias("bundle_id"))
    return bundle.identity_conflicts(names).select("directory", F.col("ids").cast("int").alias("ids"))
