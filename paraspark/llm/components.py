"""Connected components by alternating large-star and small-star.

Each round is a handful of grouped minima and joins; edges live in reliable
checkpoints, nothing is collected. A hub's edges collapse in the map-side
minimum and meet the one-row-per-node table of minima by a broadcast whose
size the counted edges bound, or by a join whose hot partitions AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import BROADCAST_ROWS, checkpointed


def _oriented(e: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, loops dropped."""
    return (e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .filter("u != v").distinct())


def _mark(e: DataFrame) -> tuple:
    """Order-independent summary of an edge set (count and a wide hash sum)."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                       F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _minima(low: DataFrame, bounded: bool) -> DataFrame:
    """Side of a join with one row per node: broadcast where the number of
    edges bounds it, else written once so that AQE can split the other side."""
    return F.broadcast(low) if bounded else checkpointed(low)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of an edge (component: its smallest
    node). Edges with a NULL end and loops are ignored; no edges give no rows."""
    e = checkpointed(_oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()))
    mark = _mark(e)
    while mark[0]:
        bounded = 2 * mark[0] <= BROADCAST_ROWS  # an edge has two nodes
        # large-star: every larger neighbour of u points to the smallest node around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), bounded)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if bounded else checkpointed(large)
        # small-star: u and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        low = low if bounded else checkpointed(low)
        star = large.join(F.broadcast(low) if bounded else low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(_oriented(star.unionByName(low.select("u", F.col("m").alias("v")))))
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
