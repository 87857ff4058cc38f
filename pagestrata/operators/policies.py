"""Decisions on single rows: what is logged where, what a route waits for, errors, accounts, and the labels that reports show."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: event kinds, idle batches, and which error names mean what
FETCH_TYPES = ("capture",)
SKIPPED_TYPES = ("page", "batch")
IDLE_BATCHES = 3
DERIVING_PREFIX = "interest."
LIST_LIMITS = {"rows": 500, "pages": 30, "bad_rows": 100, "directories": 400, "routes": 40}
QUOTA_NAME = "QuotaExceededError"
QUOTA_WORDS = "(?i)quota|storage full|no space"


def should_log(kind: Column) -> Column:
    return F.coalesce(kind != "", F.lit(False)) & ~F.coalesce(kind.isin(*SKIPPED_TYPES), F.lit(False))


def is_rare_capture(kind: Column, verdict: Column) -> Column:
    return F.coalesce(kind == "capture", F.lit(False)) & ~verdict.eqNullSafe(F.lit("ok"))


def is_fetch_event(kind: Column, verdict: Column) -> Column:
    """Routine fetches, which go to the small ring; a capture that isn't ok is rare and goes to the large one."""
    return F.coalesce(kind.isin(*FETCH_TYPES), F.lit(False)) & ~is_rare_capture(kind, verdict)


def renamed_bundles(bundles: DataFrame, user_id: str | None, username: str | None) -> DataFrame:
    """Bundles of the same account under another name; none unless both are given."""
    if not user_id or not username:
        return bundles.where("false").select("bundle_id", F.col("username").alias("was"))
    return bundles.where((F.col("user_id") == user_id) & ~F.col("username").eqNullSafe(F.lit(username))).select("bundle_id", F.col("username").alias("was"))


def waiting_for(requires: Column, completed: Column) -> Column:
    """Routes that still have to be done; in their order."""
    return F.filter(F.coalesce(requires, F.array().cast("array<string>")), lambda r: ~F.array_contains(completed, r))


def derives_work(key: Column, pagination: Column) -> Column:
    return (F.coalesce(pagination, F.lit("")) != "") | F.coalesce(F.startswith(key, F.lit(DERIVING_PREFIX)), F.lit(False))


def transport_error(name: Column, timed_out: Column) -> Column:
    """timeout, aborted, network or unknown. What can't be told is never retried."""
    stopped = name.isin("AbortError", "TimeoutError")
    return F.when(stopped & timed_out, "timeout").when(stopped, "aborted").when(name == "TypeError", "network").otherwise("unknown")


def write_error(name: Column, code: Column, message: Column) -> Column:
    quota = F.coalesce(name == QUOTA_NAME, F.lit(False)) | F.coalesce(code == 22, F.lit(False)) | F.coalesce(message.rlike(QUOTA_WORDS), F.lit(False))
    return F.when(quota, "quota").otherwise("write_failed")


def login_state(html: Column, signed_in: str, signed_out: str) -> Column:
    return F.when(html.rlike(signed_in), "logged_in").when(html.rlike(signed_out), "logged_out").otherwise("unknown")


def mismatch(expected: Sequence[tuple[str, Column]], actual: Sequence[Column]) -> Column:
    """The first named value that both sides know and that differs, as 'name a -> b'; an unknown value never differs."""
    arms = [
        F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (a != b), F.concat(F.lit(f"{name} "), a, F.lit(" -> "), b))
        for (name, a), b in zip(expected, actual, strict=True)
    ]
    return F.coalesce(*arms, F.lit(None).cast("string"))


def storage_preflight(usage: Column, quota: Column, need: Column) -> Column:
    """struct(available, enough); null where the quota isn't known, as 0 means that too."""
    available = F.greatest(F.lit(0).cast("long"), quota - F.coalesce(usage, F.lit(0)))
    return F.when(F.coalesce(quota, F.lit(0)) > 0, F.struct(available.alias("available"), (available >= need).alias("enough")))


def contiguity_label(contiguous: Column, settled: Column, gaps: Column) -> Column:
    """One of four: verified, in progress, N gaps, not finished."""
    return F.when(contiguous, "verified").when(~settled, "in progress").when(gaps > 0, F.concat(gaps.cast("string"), F.lit(" gaps"))).otherwise("not finished")


def human_time(text: Column) -> Column:
    """Minutes of a time in the session's zone; text that is no time stays."""
    return F.coalesce(F.date_format(text.try_cast("timestamp"), "yyyy-MM-dd HH:mm"), text)


def capture_title(route_name: Column, cursor_kind: Column, cursor_value: Column, subject: Column) -> Column:
    """The route's name and where in it: a page, an offset, or else the subject."""
    where = F.when(cursor_kind == "page", F.concat(F.lit("page "), cursor_value.cast("string"))).when(cursor_kind.isin("start", "offset"), F.concat(F.lit("from "), cursor_value.cast("string")))
    return F.concat_ws(" / ", route_name, F.coalesce(where, subject))


def capture_subtitle(item_count: Column, oldest: Column, newest: Column, observed_at: Column, has_item_fields: Column) -> Column:
    """Items and their span of days; else when it was fetched, and whether this archive is too old to know item times."""
    count = F.when(item_count == 0, "0 items (the end)").when(item_count.isNotNull(), F.concat(item_count.cast("string"), F.lit(" items")))
    a, b = F.substring(F.coalesce(oldest, newest), 1, 10), F.substring(F.coalesce(newest, oldest), 1, 10)
    span = F.when(a == b, a).otherwise(F.concat(a, F.lit(" to "), b))
    seen = F.concat(F.lit("fetched "), F.substring(observed_at, 1, 19), F.when(has_item_fields, "").otherwise(" (no item times in this archive)"))
    return F.concat_ws(" / ", count, F.coalesce(span, seen))


def subject_label(url: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The label of the first pattern that the URL matches, and its number."""
    arms = [F.when(F.regexp_extract(url, p, 1) != "", F.concat(F.lit(f"{label} "), F.regexp_extract(url, p, 1))) for p, label in patterns]
    return reduce(lambda a, b: F.coalesce(a, b), arms, F.lit(None).cast("string"))


def chain_headline(bundles: Column) -> Column:
    return F.when(F.coalesce(bundles, F.lit(0)) == 0, "no finished archive").when(bundles == 1, "one archive, nothing incremental yet").otherwise(F.concat(bundles.cast("string"), F.lit(" archives, from the newest back")))


def with_labels(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Names from a small dimension; keys without name keep their key. Spark broadcasts the dimension if its size allows."""
    return rows.join(labels.select(key, F.col(label).alias("own_label")), key, "left").withColumn(label, F.coalesce("own_label", key)).drop("own_label")


def nonok_tally(captures: DataFrame) -> DataFrame:
    return captures.where(~F.col("verdict").eqNullSafe(F.lit("ok"))).groupBy("route_key", "verdict").agg(F.count("*").alias("n"))


def gap_reasons(finished: Column, stopped: Column, claimed: Column, seen: Column) -> Column:
    """Gaps that the end of a run adds: pages claim items but none was seen, or the run was stopped."""
    return F.array_compact(F.array(F.when(finished & (F.coalesce(claimed, F.lit(0)) > 0) & (seen == 0), "no_items_observed"), F.when(stopped, "aborted")))


def idle_batches(batches: DataFrame, by: str, order: str, progressed: Column, limit: int = IDLE_BATCHES) -> DataFrame:
    """Each batch's run of batches without progress, and whether the drive has stalled."""
    from pagestrata.operators.sequences import network_down

    return network_down(batches, by, order, ~progressed, limit).withColumnsRenamed({"run": "idle", "down": "stalled"})


def listed(rows: DataFrame, what: str, *order: str) -> DataFrame:
    """The rows that a report shows of a list, the first in order; a report's feature, not a stage's."""
    return rows.orderBy(*order).limit(LIST_LIMITS[what])


def within_budget(batches: DataFrame, by: str, order: str, took_ms: str, budget_ms: int) -> DataFrame:
    """Batches that are begun: each drive goes on while the batches before took less than the budget, so the last one may pass it."""
    before = F.sum(took_ms).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return batches.withColumn("spent_ms", F.coalesce(before, F.lit(0))).where(F.col("spent_ms") < budget_ms)


def derived_captures(captures: DataFrame) -> DataFrame:
    """Captures with the route of the capture that they come from."""
    parents = captures.select(F.col("capture_id").alias("parent_capture_id"), F.col("route_key").alias("parent_route"))
    return captures.where("parent_capture_id is not null").join(parents, "parent_capture_id", "left")


def latest_values(writes: DataFrame, key: str = "key", order: str = "version") -> DataFrame:
    """A key-value store as the last write of each key; a last write of null removes it."""
    return writes.groupBy(key).agg(F.max_by("value", order).alias("value")).where("value is not null")
