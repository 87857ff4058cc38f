"""Operators over ordered rows: stalls, floors, watermarks, size anomalies, rings, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.times import instant_ms

# fixed values: how many barren pages stall a route, and the numbers of the size check and the rings
NO_NEW_LIMIT = 3
EMPTY_LIMIT = 2
SIZE_WINDOW = 32
SIZE_LEAST = 8
SIZE_RATIO = 0.25
NETWORK_ERRORS = 6
LARGE_RING, SMALL_RING = 1000, 200


def page_news(items: DataFrame, by: tuple[str, ...] = ("route_key",)) -> DataFrame:
    """(by, page, n_ids, new_ids, duplicates): ids not seen on an earlier page of the route, nor earlier on the same page. Rows without id keep their page."""
    keys = list(by)
    first = items.where("id is not null").groupBy(*keys, "id").agg(F.min("page").alias("page")).groupBy(*keys, "page").agg(F.count("*").alias("new_ids"))
    pages = items.groupBy(*keys, "page").agg(F.count("id").alias("n_ids"))
    out = pages.join(first, [*keys, "page"], "left").withColumn("new_ids", F.coalesce("new_ids", F.lit(0)))
    return out.withColumn("duplicates", F.col("n_ids") - F.col("new_ids"))


def stall_detection(items: DataFrame, by: tuple[str, ...] = ("route_key",), no_new: int = NO_NEW_LIMIT, empty: int = EMPTY_LIMIT) -> DataFrame:
    """page_news with the runs of pages without a new id and of empty pages, and whether the route has stalled there."""
    keys = list(by)
    news = page_news(items, by)
    news = news.withColumn("barren_run", F.sum(F.when(F.col("new_ids") == 0, 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy("page")))
    news = news.withColumn("empty_run", F.sum(F.when(F.col("n_ids") == 0, 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy("page")))
    news = news.withColumn("barren", F.sum(F.when(F.col("new_ids") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "barren_run").orderBy("page")))
    news = news.withColumn("empties", F.sum(F.when(F.col("n_ids") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "empty_run").orderBy("page")))
    return news.withColumn("stalled", (F.col("barren") >= no_new) | (F.col("empties") >= empty)).drop("barren_run", "empty_run")


def route_termination(pages: DataFrame, by: tuple[str, ...] = ("route_key",)) -> DataFrame:
    """Pages up to and with the first that ends its route (``reached_floor``, ``stalled``, ``last_page``), and why it ends, in that order."""
    why = F.when(F.col("reached_floor"), "reached_floor").when(F.col("stalled"), "stalled").when(F.col("last_page"), "last_page")
    marked = pages.withColumn("end_reason", why)
    stop = F.min(F.when(F.col("end_reason").isNotNull(), F.col("page"))).over(Window.partitionBy(*by))
    return marked.withColumn("stop_page", stop).where("stop_page is null or page <= stop_page").withColumn("end_reason", F.when(F.col("page") == F.col("stop_page"), F.col("end_reason")))


def size_anomaly(captures: DataFrame, by: str = "route_key", order: str = "seq", size: str = "length") -> DataFrame:
    """ok captures with the median size of up to 32 ok captures of the route before; flagged if under a quarter of it, once there are 8."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-SIZE_WINDOW, -1)
    before = captures.where(F.col("verdict") == "ok").withColumn("before", F.array_sort(F.collect_list(size).over(w)))
    n = F.size("before")
    middle = F.when(n > 0, (F.get("before", F.floor((n - 1) / 2).cast("int")) + F.get("before", F.floor(n / 2).cast("int"))) / 2.0)
    out = before.withColumn("n_before", n).withColumn("median_before", middle)
    return out.withColumn("anomalous", F.coalesce((F.col("n_before") >= SIZE_LEAST) & (F.col(size) / F.col("median_before") < SIZE_RATIO), F.lit(False))).drop("before")


def route_watermarks(items: DataFrame, by: str = "route_key", at: str = "ts", item: str = "id", order: tuple[str, ...] = ("page", "pos")) -> DataFrame:
    """Highest and lowest time of each route, and the distinct ids at the highest, in order of arrival."""
    marks = items.where(F.col(at).isNotNull()).groupBy(by).agg(F.max(at).alias("high"), F.min(at).alias("low"))
    ends = items.join(marks.select(by, "high"), by).where((F.col(at) == F.col("high")) & F.col(item).isNotNull())
    firsts = ends.groupBy(by, item).agg(F.min(F.struct(*order)).alias("first"))
    ids = firsts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", F.col(item).alias("id")))), lambda e: e["id"]).alias("high_ids"))
    return marks.join(ids, by, "left").withColumn("high_ids", F.coalesce("high_ids", F.array().cast(ids.schema["high_ids"].dataType)))


def page_floors(items: DataFrame, floors: DataFrame, by: str = "route_key", at: str = "ts", raw: str = "raw") -> DataFrame:
    """(by, page, reached_floor, unparsable): whether a page has a time at or before its route's floor, and how many of its times are text that is none, each a gap. Missing times are neither."""
    rows = items.join(floors.select(by, "floor"), by, "left")
    return rows.groupBy(by, "page").agg(
        F.coalesce(F.max(F.col(at) <= F.col("floor")), F.lit(False)).alias("reached_floor"),
        F.sum(F.when(F.col(at).isNull() & (F.coalesce(raw, F.lit("")) != ""), 1).otherwise(0)).alias("unparsable"),
    )


def item_time_range(items: DataFrame, by: tuple[str, ...] = ("route_key", "page"), raw: str = "raw", order: str = "pos") -> DataFrame:
    """The oldest and newest time of each page, as written: compared as instants, the first of equal ones kept. Text that is no time with an offset doesn't count; pages without any have no row."""
    ms = instant_ms(F.col(raw))
    timed = items.withColumn("ms", ms).where(F.col("ms").isNotNull())
    return timed.groupBy(*by).agg(F.min_by(raw, F.struct("ms", order)).alias("oldest"), F.max_by(raw, F.struct(F.col("ms"), (-F.col(order)).alias("turn"))).alias("newest"))


def can_advance(finished: Column, gaps: Column, stopped: Column, high: Column) -> Column:
    """A watermark moves only after a clean, complete run."""
    return finished & (F.size(gaps) == 0) & ~stopped & high.isNotNull()


def progress_marker(items: DataFrame, by: str = "route_key", at: str = "ts") -> DataFrame:
    """Running minimum over pages of each page's upper median time: one stray old item does not move it."""
    times = items.where(F.col(at).isNotNull()).groupBy(by, "page").agg(F.array_sort(F.collect_list(at)).alias("times"))
    pages = times.select(by, "page", F.get("times", F.floor(F.size("times") / 2).cast("int")).alias("page_median"))
    return pages.withColumn("progress", F.min("page_median").over(Window.partitionBy(by).orderBy("page")))


def floor_filter(items: DataFrame, floors: DataFrame, by: str = "route_key", at: str = "ts") -> DataFrame:
    """Items with ``below_floor``: at or before their route's floor; a route without floor has none below."""
    return items.join(floors.select(by, "floor"), by, "left").withColumn("below_floor", F.coalesce(F.col(at) <= F.col("floor"), F.lit(False)))


def event_rings(events: DataFrame, small: Column, large_cap: int = LARGE_RING, small_cap: int = SMALL_RING, order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """The latest events of two rings: routine ones in the small, the rest in the large. Top-k by ring, no global sort of the log."""
    newest = [F.col(c).desc() for c in order]
    routine = F.coalesce(small, F.lit(False))
    return (
        events.where(~routine).orderBy(*newest).limit(large_cap).withColumn("ring", F.lit("large"))
        .unionByName(events.where(routine).orderBy(*newest).limit(small_cap).withColumn("ring", F.lit("small")))
    )


def network_down(events: DataFrame, by: str, order: str, failed: Column, limit: int = NETWORK_ERRORS) -> DataFrame:
    """Each event's run of consecutive failures, and whether it means that the network is down; any success resets."""
    w = Window.partitionBy(by).orderBy(order)
    marked = events.withColumn("failed", failed).withColumn("island", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    run = F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(Window.partitionBy(by, "island").orderBy(order))
    return marked.withColumn("run", run).withColumn("down", F.col("run") >= limit).drop("island", "failed")


def capture_lineage(captures: DataFrame, by: str = "route_key", order: str = "seq") -> DataFrame:
    """``parent``: the given one; else the route's capture before, unless the row says explicitly that it has none."""
    before = F.lag("capture_id").over(Window.partitionBy(by).orderBy(order))
    return captures.withColumn("parent", F.coalesce("parent_capture_id", F.when(~F.col("no_parent"), before)))


def gate_waits(requests: DataFrame, by: str, order: str, started: str, finished: str, target_ms: int) -> DataFrame:
    """How long each request of a lane had to wait after the one before it finished."""
    before = F.lag(finished).over(Window.partitionBy(by).orderBy(order))
    return requests.withColumn("wait_ms", F.greatest(F.lit(0), F.lit(target_ms) - F.coalesce(F.col(started) - before, F.lit(target_ms))))


def frontier_next(frontier: DataFrame, started: DataFrame, n: int = 1) -> DataFrame:
    """The next items of a queue snapshot: pending, gate open, route not blocked; by priority, then routes already begun, then first in."""
    held = (F.col("state").isin("in_flight", "awaiting_human")) | ((F.col("state") == "failed") & F.col("ordered"))
    blocked = frontier.where(held).select("route_key").distinct()
    ready = frontier.where((F.col("state") == "pending") & F.col("gate_open")).join(blocked, "route_key", "left_anti")
    begun = started.select("route_key").distinct().withColumn("begun", F.lit(0))
    return ready.join(begun, "route_key", "left").withColumn("begun", F.coalesce("begun", F.lit(1))).orderBy("priority", "begun", "seq").limit(n).drop("begun")


def replay_list(captures: DataFrame, since: int, derives: Column, cap: int = 100) -> DataFrame:
    """The newest captures after ``since`` that lead to more work, up to ``cap``."""
    return captures.where((F.col("seq") > since) & derives).orderBy(F.col("seq").desc()).limit(cap)


def replay_truncated(captures: DataFrame, since: int, derives: Column, cap: int = 100) -> DataFrame:
    """How many captures ``replay_list`` leaves out: one row."""
    return captures.where((F.col("seq") > since) & derives).agg(F.greatest(F.lit(0), F.count("*") - cap).alias("truncated"))


def open_gates(frontier: DataFrame, state: DataFrame) -> DataFrame:
    """Routes whose run can advance and that have nothing pending: what waits for them may go."""
    busy = frontier.where(F.col("state") == "pending").select("route_key").distinct()
    return state.where("can_advance").select("route_key").distinct().join(busy, "route_key", "left_anti")


def gated(frontier: DataFrame, gates: DataFrame) -> DataFrame:
    """The queue with ``gate_open``: an item without ``gated_by`` is never held."""
    opened = gates.select(F.col("route_key").alias("gated_by"), F.lit(True).alias("opened"))
    return frontier.join(opened, "gated_by", "left").withColumn("gate_open", F.col("gated_by").isNull() | F.coalesce("opened", F.lit(False))).drop("opened")
