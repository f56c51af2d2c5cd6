"""Parallelism sizing for CPU-heavy per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, min_partitions: int | None = None,
           unique_key: list[str] | None = None) -> DataFrame:
    """Repartition only when ``df`` has fewer partitions than the cluster's
    default parallelism.

    Per-row text work (regex cleaning, tokenising, HTML extraction) runs in
    the scan's tasks; a table stored as one large row group would otherwise be
    processed by a single task. On large inputs the scan already has more
    splits than cores and this is a no-op, so no shuffle is added at scale.
    Apply it to a scan: the partition count of a plan with exchanges is only
    known after the runtime has executed them.
    With ``unique_key`` rows are hash-partitioned on that key; without it
    round-robin repartitioning sorts rows first, so a retried task sees the
    same rows.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    if unique_key:
        # hashing a per-row unique key: even spread, no hot value, and no
        # pre-sort (round-robin sorts every partition to stay deterministic)
        return df.repartition(target, *[F.col(k) for k in unique_key])
    return df.repartition(target)
