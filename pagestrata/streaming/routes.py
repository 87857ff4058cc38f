"""Streams of captures: route state with a watermark that moves only after a clean run, stalls, and windowed counts.

Spark's own watermark moves with every event; here a run's high water is kept as pending and becomes the route's watermark only
when the run ends complete, without gaps and unstopped. Seen ids are exact state, as duplicates are free but gaps are for good: they
are a map in the state store, of which a micro-batch touches only the ids that it brings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagestrata.operators.sequences import EMPTY_LIMIT, NO_NEW_LIMIT

MARKS = ("high long", "pending long", "low long", "gaps int", "barren int", "empties int", "pages long", "items long", "stalled boolean")
OUTPUT = "route_key string, high_water long, pending_high long, low_water long, gaps int, pages long, items long, stalled boolean"
STORE_SETTING, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = (None, None, None, 0, 0, 0, 0, 0, False)


def fold(marks: tuple, rows: pd.DataFrame, is_new: Callable[[int, int], bool]) -> tuple:
    """The marks after some rows: kind (page, gap, end), page, id, ts, raw.

    A page without a new id is barren, one without any id empty; runs of either stall the route. A time as text that could not be
    read (raw without ts) is a gap; a missing one isn't. ``is_new`` remembers the ids that it is asked for.
    """
    high, pending, low, gaps, barren, empties, pages, items, stalled = marks
    for (page, kind), part in rows.sort_values(["page", "kind"], kind="stable").groupby(["page", "kind"], sort=True):
        if kind == "gap":
            gaps += len(part)
        elif kind == "end":
            if gaps == 0 and pending is not None:
                high = pending if high is None else max(high, pending)
            pending, gaps = None, 0
        else:
            found = {int(i) for i in part["id"].dropna()}
            times = part["ts"].dropna()
            if len(times):
                top, bottom = int(times.max()), int(times.min())
                pending = top if pending is None else max(pending, top)
                low = bottom if low is None else min(low, bottom)
            gaps += int((part["ts"].isna() & (part["raw"].fillna("") != "")).sum())
            fresh = sum(is_new(i, int(page)) for i in sorted(found))
            barren = 0 if fresh else barren + 1
            empties = 0 if found else empties + 1
            stalled = stalled or barren >= NO_NEW_LIMIT or empties >= EMPTY_LIMIT
            pages, items = pages + 1, items + len(found)
    return high, pending, low, int(gaps), int(barren), int(empties), int(pages), int(items), bool(stalled)


def _told(route: str, marks: tuple) -> pd.DataFrame:
    high, pending, low, gaps, _, _, pages, items, stalled = marks
    out = pd.DataFrame([(route, high, pending, low, gaps, pages, items, stalled)], columns=[f.split()[0] for f in OUTPUT.split(", ")])
    return out.astype({"high_water": "Int64", "pending_high": "Int64", "low_water": "Int64"})


class RouteState(StatefulProcessor):
    """Marks of a route as one value, its seen ids as a map from id to the page that had it first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", ", ".join(MARKS))
        self.seen = handle.getMapState("seen", "id long", "page long")

    def _is_new(self, number: int, page: int) -> bool:
        if self.seen.containsKey((number,)):
            return False
        self.seen.updateValue((number,), (page,))
        return True

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        marks = self.marks.get() if self.marks.exists() else START
        marks = fold(tuple(marks), pd.concat(list(rows)), self._is_new)
        self.marks.update(marks)
        yield _told(key[0], marks)

    def close(self) -> None:
        pass


def route_state(rows: DataFrame) -> DataFrame:
    """A row for each route that a micro-batch touched, with its state after the batch. Start it ``with map_state(spark)``."""
    return rows.groupBy("route_key").transformWithStateInPandas(RouteState(), OUTPUT, "update", "none")


def route_state_at_once(rows: DataFrame) -> DataFrame:
    """The same of a table: what a stream's last rows say after all of it came in order. A route is one group in memory."""
    def whole(route: tuple, part: pd.DataFrame) -> pd.DataFrame:
        seen: set[int] = set()

        def is_new(number: int, page: int) -> bool:
            fresh = number not in seen
            seen.add(number)
            return fresh

        return _told(route[0], fold(START, part, is_new))

    return rows.groupBy("route_key").applyInPandas(whole, OUTPUT)


class map_state:  # noqa: N801
    """While it lasts, streams that are started keep their state in RocksDB, which maps need; then the session's setting is as before."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STORE_SETTING, None)
        self.spark.conf.set(STORE_SETTING, STORE)

    def __exit__(self, *_) -> None:
        self.spark.conf.unset(STORE_SETTING) if self.before is None else self.spark.conf.set(STORE_SETTING, self.before)


def event_windows(events: DataFrame, at: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and type. The time must have a zone: a plain one is taken as the session's."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("window"), "event_type").agg(F.count("*").alias("n"))


def session_windows(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap).alias("session"), key).agg(F.count("*").alias("n"))


def write_idempotent(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Micro-batches as parquet folders named by batch id, written over if a batch is replayed; duplicates of a key within a batch go."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
