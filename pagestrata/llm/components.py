"""Connected components of a graph too large for the driver: every node gets the smallest node it is connected with.

Large-star and small-star steps alternate until the edges are stars around the smallest nodes. Each round's edges are a written
table in the shared folder, so lineage stays short. A star's hub is aggregated before it is joined, and hubs with much of the graph
are dealt over salts.

Defined cases: a null end or an edge from a node to itself adds nothing; repeated edges count once; no edges, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.shared import spread_join, written

MAX_ROUNDS = 50


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    return spread_join(edges, written(low, "low"), "a", F.xxhash64("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (columns a and b), its root being the smallest node of its component."""
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS if mark[0] else 0):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("times")).select("a", F.least("a", "low").alias("low"), "times")
        large = written(_with_low(both, low).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("times"))
        small = _with_low(large, low).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
        after = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        if (seen := _mark(after)) == mark:
            break
        now, mark = after, seen
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
