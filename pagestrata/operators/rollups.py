"""Roll-ups of captures, segments, files and queues. All are partial aggregates; none reads payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.ids import segment_kind, segment_number

# fixed values: queue states, the routes that known captures come from, and files beside an archive's own
STATES = ("pending", "in_flight", "done", "failed", "awaiting_human", "terminal_stop")
ITEM_ROUTES = ("interest.item",)
LONGFORM_ROUTES = ("note.item", "review.item")
ASSET_PREFIX = "asset."
EXTRA_FILES = ("manifest.json", "README.txt", "checkpoint.json")


def index_counts(captures: DataFrame) -> DataFrame:
    """(dimension, value, n) of verdict, surface and intent, in one pass."""
    dims = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in ("verdict", "surface", "intent"))))
    return captures.select(dims.alias("d")).select("d.*").where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def bundle_summary(captures: DataFrame) -> DataFrame:
    """(bundle_id, dimension, value, captures, bytes): of each bundle's routes and verdicts, in one pass."""
    dims = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("route_key", "verdict"))))
    rows = captures.select("bundle_id", "length", dims.alias("d")).select("bundle_id", "length", "d.*")
    return rows.groupBy("bundle_id", "dimension", "value").agg(F.count("*").alias("captures"), F.sum("length").alias("bytes"))


def bundle_sizes(captures: DataFrame, segments: DataFrame) -> DataFrame:
    """Captures and bytes of each bundle: exact where its manifest declares segments, else the sum of its records, which is a lower bound."""
    own = captures.groupBy("bundle_id").agg(F.count("*").alias("captures"), F.sum("length").alias("record_bytes"))
    declared = segments.groupBy("bundle_id").agg(F.sum("bytes").alias("segment_bytes"))
    both = own.join(declared, "bundle_id", "left")
    return both.select("bundle_id", "captures", F.coalesce("segment_bytes", "record_bytes").alias("total_bytes"), F.col("segment_bytes").isNotNull().alias("exact"))


def items_by_route(captures: DataFrame) -> DataFrame:
    """Items of ok captures (a missing or empty verdict counts as ok); a capture without count is one item, a count of 0 is none."""
    good = F.coalesce(F.nullif(F.col("verdict"), F.lit("")), F.lit("ok")) == "ok"
    return captures.where(good).groupBy("route_key").agg(F.sum(F.coalesce("item_count", F.lit(1))).alias("items"))


def segment_state(captures: DataFrame) -> DataFrame:
    """Records, first and last capture of each segment."""
    return captures.groupBy("segment").agg(F.count("*").alias("records"), F.min_by("capture_id", "seq").alias("first_capture_id"), F.max_by("capture_id", "seq").alias("last_capture_id"))


def segment_numbers(captures: DataFrame) -> DataFrame:
    """Segments of each kind and the highest number among them, where the next one goes on; names of another shape don't count."""
    named = captures.select("segment").distinct().select(segment_kind(F.col("segment")).alias("kind"), segment_number(F.col("segment")).alias("number")).where("kind is not null and number is not null")
    return named.groupBy("kind").agg(F.count("*").alias("segments"), F.max("number").alias("highest"))


def segment_extents(captures: DataFrame) -> DataFrame:
    return captures.groupBy("segment").agg(F.max(F.col("offset") + F.col("length")).alias("extent"))


def segment_reconcile(captures: DataFrame, segments: DataFrame) -> DataFrame:
    """Declared against indexed records of each segment: ok, count_mismatch, not_indexed or undeclared."""
    seen = captures.groupBy("segment").agg(F.count("*").alias("indexed"))
    both = segments.select(F.col("filename").alias("segment"), "record_count").join(seen, "segment", "full")
    status = F.when(F.col("record_count").isNull(), "undeclared").when(F.coalesce("indexed", F.lit(0)) == F.col("record_count"), "ok").when(F.col("indexed").isNull(), "not_indexed").otherwise("count_mismatch")
    return both.select("segment", "record_count", F.coalesce("indexed", F.lit(0)).alias("indexed"), status.alias("status"))


def version_history(captures: DataFrame, at_least: int = 2) -> DataFrame:
    """Pages captured more than once: how often, and their captures from the newest."""
    listed = F.sort_array(F.collect_list(F.struct("observed_at", "capture_id")), asc=False)
    return captures.groupBy("url_key").agg(F.count("*").alias("versions"), listed.alias("captures")).where(F.col("versions") >= at_least)


def known_captures(captures: DataFrame) -> DataFrame:
    """(bucket, url_key, route_key) of pages that need not be fetched again; only ok ones, as gone pages may come back. A long-form key keeps its last route."""
    r = F.col("route_key")
    bucket = F.when(r.isin(*ITEM_ROUTES), "item").when(r.isin(*LONGFORM_ROUTES), "longform").when(F.startswith(r, F.lit(ASSET_PREFIX)), "asset")
    rows = captures.where("verdict = 'ok'").withColumn("bucket", bucket).where("bucket is not null and url_key is not null")
    return rows.groupBy("bucket", "url_key").agg(F.when(F.first("bucket") == "longform", F.max_by("route_key", "seq")).alias("route_key"))


def storage_usage(files: DataFrame, active: str | None = None) -> DataFrame:
    """Bytes, files and whether there is a manifest, of each bundle; the one being written can't be deleted."""
    out = files.groupBy("bundle_id").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.count("*").alias("files"), F.max(F.col("name") == "manifest.json").alias("has_manifest"))
    return out.withColumn("deletable", ~F.coalesce(F.col("bundle_id") == F.lit(active), F.lit(False)))


def export_state(usage: DataFrame, exported: DataFrame, usable: bool = True) -> DataFrame:
    """exported, not_exported, or unknown where the records of exports can't be trusted."""
    out = usage.join(exported.select("bundle_id", "exported_at"), "bundle_id", "left")
    return out.withColumn("export_state", F.when(F.col("exported_at").isNotNull(), "exported").otherwise("not_exported" if usable else "unknown"))


def frontier_counts(frontier: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """Items in each state, 0 included."""
    every = frontier.sparkSession.createDataFrame([(s,) for s in states], "state string")
    seen = frontier.groupBy("state").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(seen, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def home_account(bundles: DataFrame) -> DataFrame:
    """The account most bundles have; of ties, the first seen (existing ones before candidates)."""
    rank = F.struct(F.col("candidate").cast("int").alias("late"), "pos")
    counts = bundles.where("account_user_id is not null").groupBy("account_user_id").agg(F.count("*").alias("bundles"), F.min(rank).alias("first"))
    return counts.orderBy(F.col("bundles").desc(), "first").limit(1).select("account_user_id", "bundles")


def verdict_tally(captures: DataFrame) -> DataFrame:
    return captures.groupBy("verdict").agg(F.count("*").alias("n"))


def claimed_delta(coverage: DataFrame) -> DataFrame:
    """Captured less claimed; null where either isn't known."""
    return coverage.withColumn("delta", F.col("captured_count") - F.col("claimed_count"))


def verification(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("checked"), F.sum(F.when(F.col("problem").isNull(), 1).otherwise(0)).alias("ok"), F.sum(F.when(F.col("problem").isNotNull(), 1).otherwise(0)).alias("problems"))
