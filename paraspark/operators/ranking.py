"""Distributed dense numbering (H3) and what builds on it.

``with_row_index`` gives rows 1..n following an order without a
single-partition window. Spark's sampled range partitioner places the rows;
the partition id and the position inside the sorted partition are stored with
them in one reliable checkpoint, so they are the same for every branch of the
plan and every task retry. One total per partition (a table of one row per
partition, broadcast-safe) gives each partition's offset; the position inside
gives the rest. Any number of partitions; nothing on the driver but the
partitioner's bounded sample.

Keys must be non-null and should form a total order (unique keys): with
ties the numbering is still dense and exact but ties may swap places between
runs, and one tied value cannot be split across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _key(c) -> tuple[Column, bool]:
    """(expression, ascending) from a name, a Column or an (expr, asc) pair."""
    if isinstance(c, tuple):
        e, asc = c
        return (F.col(e) if isinstance(e, str) else e), asc
    return (F.col(c) if isinstance(c, str) else c), True


def _placed(df: DataFrame, order_cols: list, num_partitions: int | None):
    """Checkpointed rows with ``_bucket`` (their range partition) and ``_pos``
    (their position in it), the order, and the key columns that were added."""
    from paraspark.session import ensure_checkpoint_dir
    keys = [_key(c) for c in order_cols]
    # a key that is a plain column is used as it is; expressions become
    # synthetic columns (returned so the caller drops them afterwards)
    names = [(c[0] if isinstance(c, tuple) else c) for c in order_cols]
    k_names = [n if isinstance(n, str) and n in df.columns else f"_k{i}" for i, n in enumerate(names)]
    added = [n for n in k_names if n not in df.columns]
    keyed = df.select("*", *[e.alias(n) for (e, _), n in zip(keys, k_names) if n in added])
    order = [F.col(n).asc() if asc else F.col(n).desc() for n, (_, asc) in zip(k_names, keys)]
    ensure_checkpoint_dir(df.sparkSession)
    pid = F.spark_partition_id()
    # monotonically_increasing_id keeps the partition index in its upper 31
    # bits and the row's position in the lower 33 (documented layout)
    ranged = (keyed.repartitionByRange(max(1, _partitions(df, num_partitions)), *order).sortWithinPartitions(*order)
              .withColumn("_bucket", pid)
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)))
    return ranged.checkpoint(eager=True), order, added


def _offsets(per_bucket: DataFrame) -> DataFrame:
    """Exclusive prefix sums over the per-bucket totals (one row per bucket:
    bounded, broadcast-safe)."""
    return per_bucket.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))


def with_row_index(df: DataFrame, order_cols: list, name: str = "row_index", start: int = 1,
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start, start+1, ... following ``order_cols``.

    ``order_cols`` items are names, Columns (ascending) or (expr, ascending)
    pairs. The input is read once for the partitioner's sample and once to be
    written; the index is the partition's offset plus the position, with no
    window and no further shuffle of the rows.
    """
    b, _, added = _placed(df, order_cols, num_partitions)
    offsets = _offsets(b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))
    return (b.join(F.broadcast(offsets), "_bucket").withColumn(name, F.col("_off") + F.col("_pos") + F.lit(start))
            .drop("_bucket", "_pos", "_off", *added))


def with_running_total(df: DataFrame, order_cols: list, weight: str, name: str = "running_total",
                       num_partitions: int | None = None) -> DataFrame:
    """Add the inclusive running sum of ``weight`` following ``order_cols``
    (placed like ``with_row_index``; keys should be unique)."""
    b, _, added = _placed(df, order_cols, num_partitions)
    offsets = _offsets(b.groupBy("_bucket").agg(F.sum(weight).alias("_n")))
    w = Window.partitionBy("_bucket").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = b.withColumn("_run", F.sum(weight).over(w)).join(F.broadcast(offsets), "_bucket")
    return out.withColumn(name, F.col("_off") + F.col("_run")).drop("_bucket", "_pos", "_run", "_off", *added)


def exact_quantiles(df: DataFrame, value: str, probs: list[float],
                    num_partitions: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas/numpy default) without collecting
    values into one buffer.

    Values are first counted per distinct value (a hot value collapses in the
    map-side partial aggregate), the distinct values get a running count in
    value order, and each target rank picks the value whose count range
    holds it. The per-value counts are materialised once (reliable
    checkpoint). Only the total count (one scalar) reaches the driver. One
    row, one column per probability named ``q<percent>``."""
    spark = df.sparkSession
    vals = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    vc = vals.groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    # the count, the bucket-bound sample and the running total all read the
    # per-value counts: write them once to the shared checkpoint folder
    # instead of recomputing the input three times
    from paraspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    vc = vc.checkpoint(eager=True)
    n = vc.agg(F.sum("_c")).first()[0] or 0
    names = [f"q{int(round(p * 100))}" for p in probs]
    if n == 0:
        return spark.createDataFrame([tuple(None for _ in probs)], ", ".join(f"{c} DOUBLE" for c in names))
    cum = with_running_total(vc, ["_v"], "_c", "_cum", num_partitions)
    start = F.col("_cum") - F.col("_c")

    def at(rank: int):
        return (start <= F.lit(rank)) & (F.lit(rank) < F.col("_cum"))

    targets = []
    for p in probs:
        pos = p * (n - 1)
        lo, hi = int(pos // 1), int(-(-pos // 1))
        targets.append((lo, hi, pos - lo))
    needed = None
    for lo, hi, _ in targets:
        cond = at(lo) | at(hi)
        needed = cond if needed is None else (needed | cond)
    picked = cum.filter(needed)
    cols = []
    for (lo, hi, frac), name in zip(targets, names):
        v_lo = F.max(F.when(at(lo), F.col("_v")))
        v_hi = F.max(F.when(at(hi), F.col("_v")))
        cols.append((v_lo + F.lit(frac) * (v_hi - v_lo)).alias(name))
    return picked.agg(*cols)


def approx_quantiles(df: DataFrame, value: str, probs: list[float], rank_error: float = 0.001) -> DataFrame:
    """F9 by a mergeable sketch, one pass and no shuffle of the values: each
    quantile's rank is within ``rank_error`` of the wanted one (as a share of
    all rows). The sketch of a task holds about ``1 / rank_error`` values."""
    names = [f"q{round(p * 100):02d}" for p in probs]
    found = F.percentile_approx(F.col(value).cast("double"), probs, int(-(-1 // rank_error)))
    return df.agg(found.alias("q")).select(*[F.col("q")[i].alias(n) for i, n in enumerate(names)])
