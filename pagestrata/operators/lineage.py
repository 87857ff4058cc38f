"""Chains of bundles: who follows whom, where each route's next run may start, and what is proven without a hole.

Walks are recursive SQL over (bundle, previous) pairs; every step is a join, so chains may be as many as the cluster holds. A
walk's depth is bounded by ``MAX_DEPTH``, and cycles end at the first bundle met again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.storage import new_path

MAX_DEPTH = 1000


def pick_floors(state: DataFrame, order: tuple[str, ...] = ("time_key", "bundle_id")) -> DataFrame:
    """The newest advanced run of each route: where the next one may stop. max_by instead of a window keeps it a partial aggregate."""
    good = state.where(F.col("advanced") & F.col("high_water_time").isNotNull())
    best = F.max_by(F.struct("bundle_id", "high_water_time"), F.struct(*order))
    return good.groupBy("route_key").agg(best.alias("b")).select("route_key", F.col("b.bundle_id").alias("floor_from_bundle_id"), F.col("b.high_water_time").alias("floor_time"))


def _recursive(spark: SparkSession, text: str) -> DataFrame:
    """A recursive statement, run under limits of its own: its rows are written, and the session's settings are as before."""
    limits = {"spark.sql.cteRecursionLevelLimit": str(MAX_DEPTH), "spark.sql.cteRecursionRowLimit": "-1"}
    before = {k: spark.conf.get(k, None) for k in limits}
    path = new_path(spark, "walk")
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        found = spark.sql(text)
        found.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(found.schema).parquet(path)


def _walk(pairs: DataFrame, starts: DataFrame, columns: str) -> DataFrame:
    """Rows (head, bundle_id, depth) of every start's walk along ``previous_bundle_id``."""
    spark = pairs.sparkSession
    tag = uuid.uuid4().hex
    p, s = f"pairs_{tag}", f"starts_{tag}"
    pairs.createOrReplaceTempView(p)
    starts.createOrReplaceTempView(s)
    return _recursive(spark, f"""
        WITH RECURSIVE walk(head, bundle_id, next_id, depth, path) AS (
          SELECT s.head, p.bundle_id, p.previous_bundle_id, 0, array(p.bundle_id) FROM {s} s JOIN {p} p ON s.head = p.bundle_id
          UNION ALL
          SELECT w.head, p.bundle_id, p.previous_bundle_id, w.depth + 1, array_append(w.path, p.bundle_id)
          FROM walk w JOIN {p} p ON w.next_id = p.bundle_id WHERE NOT array_contains(w.path, p.bundle_id))
        SELECT {columns} FROM walk""")


def chain_walk(bundles: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, bundle_id, depth): each head's predecessors, until one is missing or met again."""
    return _walk(bundles.select("bundle_id", "previous_bundle_id"), heads.select("head"), "head, bundle_id, depth")


def chain_heads(bundles: DataFrame) -> DataFrame:
    """Bundles that no newer bundle reaches; forks share their tails. Newer: larger (time_key, bundle_id)."""
    reach = chain_walk(bundles, bundles.select(F.col("bundle_id").alias("head")))
    order = bundles.select("bundle_id", F.struct("time_key", "bundle_id").alias("turn"))
    met = reach.where("head <> bundle_id").join(order.select(F.col("bundle_id").alias("head"), F.col("turn").alias("head_turn")), "head").join(order, "bundle_id").where("head_turn > turn")
    return bundles.join(met.select("bundle_id").distinct(), "bundle_id", "left_anti")


def chain_holes(state: DataFrame) -> DataFrame:
    """Floors whose source isn't in the chain (absent) or says another high water (mismatch)."""
    source = state.select(F.col("bundle_id").alias("floor_from_bundle_id"), "route_key", F.col("high_water_time").alias("source_time"), F.lit(True).alias("found"))
    both = state.where("floor_from_bundle_id is not null").join(source, ["floor_from_bundle_id", "route_key"], "left")
    kind = F.when(F.col("found").isNull(), "absent").when(~F.col("source_time").eqNullSafe(F.col("floor_time")), "mismatch")
    return both.select("bundle_id", "route_key", "floor_from_bundle_id", kind.alias("hole")).where("hole is not null")


def _proven(rows: Column) -> Column:
    """Whether a route's rows (newest first) prove it without a hole: from the newest on, each contiguous run names the source of its floor, down to one that had no floor. A walk that meets no end within the rows is a cycle."""
    row = lambda cur: F.get(F.filter(rows, lambda r: r["bundle_id"] == cur), 0)

    def told(r: Column) -> Column:
        return F.when(~F.coalesce(r["contiguous"], F.lit(False)), False).when(r["floor_time"].isNull(), True).when(r["source"].isNull(), False)

    def step(walk: Column, _: Column) -> Column:
        now = F.transform(F.array(row(walk["cur"])), lambda r: F.struct(r["source"].alias("cur"), told(r).alias("proven")))
        return F.when(walk["proven"].isNotNull(), walk).otherwise(F.get(now, 0))

    start = F.struct(F.get(rows, 0)["bundle_id"].alias("cur"), F.lit(None).cast("boolean").alias("proven"))
    return F.coalesce(F.aggregate(rows, start, step)["proven"], F.lit(False))


def chain_coverage(state: DataFrame) -> DataFrame:
    """Of each route in one chain (``pos`` counts from the newest bundle): reach, bundles, gaps, and whether it is proven contiguous.

    A hole anywhere on the route breaks the proof. Routes that never had a high water need every run to be contiguous. A route's rows,
    one a bundle of the chain, are brought together once; walks and holes are worked out there.
    """
    row = F.struct("pos", "bundle_id", "contiguous", "floor_time", F.col("floor_from_bundle_id").alias("source"), "high_water_time", "gaps")
    routes = state.groupBy("route_key").agg(
        F.max("high_water_time").alias("newest"), F.min("low_water_time").alias("oldest"), F.min("contiguous").alias("all_contiguous"),
        F.array_sort(F.collect_list(row)).alias("rows"),
    )
    rows = F.col("rows")
    held = lambda r: F.exists(rows, lambda s: (s["bundle_id"] == r["source"]) & s["high_water_time"].eqNullSafe(r["floor_time"]))
    holes = F.size(F.filter(rows, lambda r: r["source"].isNotNull() & ~held(r)))
    out = routes.select("route_key", "newest", "oldest", F.transform(rows, lambda r: r["bundle_id"]).alias("bundles"), "all_contiguous", _proven(rows).alias("proven"), holes.cast("long").alias("holes"), F.flatten(F.transform(rows, lambda r: r["gaps"])).alias("gaps"))
    ok = F.when(F.col("newest").isNull(), F.col("all_contiguous")).otherwise(F.col("proven"))
    return out.select("route_key", "newest", "oldest", "bundles", (ok & (F.col("holes") == 0)).alias("contiguous"), "holes", "gaps")
