"""Incremental corpus ingest with Structured Streaming (L1, L2).

Both compare rows by the SHA-256 digest of their null-safe key: two different
keys share one with probability about 2^-128 even at 10^12 keys. The target is
a table of loads (``sources.loads``), one per micro-batch, and beside it lies
an index of its rows' digests: 32 bytes a row, in folders by the digest's
first bits. A micro-batch

1. is written once to a staging folder (the transform runs once), with the
   digests and a number for every row;
2. reads the digests of the index folders it touches, and no others, to find
   which of its keys are known, and the first row of each other key (digests
   and row numbers are shuffled for that, texts are not);
3. writes those rows and their digests as a load, and publishes it.

A micro-batch that is replayed after a crash finds its load published and adds
nothing, or writes it again. The load's name is the query's id in the
checkpoint and the batch's number.

L2 keeps no key state at all. L1 keeps the digests of the keys that arrived
within ``remember`` in streaming state and drops their repeats before they
reach the index; older digests leave the state, which so is bounded by the
arrivals of that time and not by the corpus. No repeat gets in on account of
that (the index knows every key of the target) and no row is lost: arrival
time never lies behind the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from paraspark.operators.bitmap import rows_in
from paraspark.operators.digest import DIGEST, key_digest
from paraspark.session import ensure_checkpoint_dir, remove_folder
from paraspark.sources import loads as LD

PREFIX, ARRIVED, ROW = "_prefix", "_arrived", "_row"
#: Index folders: the digest's first six bits.
PREFIXES = 64
INDEX_SCHEMA = StructType([StructField(DIGEST, BinaryType()), StructField(PREFIX, IntegerType())])


def digest_prefix(digest: str = DIGEST) -> Column:
    first = F.conv(F.substring(F.hex(F.col(digest)), 1, 2), 16, 10).cast("int")
    return F.floor(first * PREFIXES / 256).cast("int")


def index_path(target: str) -> str:
    return target.rstrip("/") + ".digests"


def known_digests(spark: SparkSession, target: str, prefixes: list[int], ids: list[str] | None = None) -> DataFrame:
    """Digests of the target's rows (of the published loads, or of ``ids``) in
    the given index folders (a partition filter)."""
    ids = LD.published(spark, target) if ids is None else ids
    if not ids:
        return spark.createDataFrame([], INDEX_SCHEMA)
    index = index_path(target)
    return (spark.read.schema(INDEX_SCHEMA).option("basePath", index).parquet(*[f"{index}/{LD.LOAD}={i}" for i in ids])
            .filter(F.col(PREFIX).isin(prefixes)).select(DIGEST))


def absorb(batch: DataFrame, target: str, load_id: str, fields: list[str]) -> None:
    """Add the rows of ``batch`` (with ``DIGEST``) whose digest the target lacks."""
    spark = batch.sparkSession
    if LD.is_published(spark, target, load_id):
        # a replay; streaming state is committed by reading the batch all the same
        batch.write.format("noop").mode("overwrite").save()
        return
    staging = f"{target.rstrip('/')}.staged/{load_id}"
    (batch.select(*fields, DIGEST).withColumn(PREFIX, digest_prefix()).withColumn(ROW, F.monotonically_increasing_id())
     .write.mode("overwrite").option("compression", "zstd").parquet(staging))
    rows = spark.read.parquet(staging)
    # at most PREFIXES small integers
    touched = sorted(r[0] for r in rows.select(PREFIX).distinct().collect())
    if touched:
        ensure_checkpoint_dir(spark)
        # digests meet digests; no text is shuffled
        once = rows.groupBy(DIGEST, PREFIX).agg(F.min(ROW).alias(ROW))
        fresh = once.join(known_digests(spark, target, touched), DIGEST, "left_anti").checkpoint(eager=True)
        LD.write_load(rows_in(rows, fresh.select(ROW), ROW).select(*fields), target, load_id)
        LD.write_load(fresh.select(DIGEST, PREFIX).hint("rebalance", PREFIX).sortWithinPartitions(PREFIX, DIGEST), index_path(target), load_id, [PREFIX])
        LD.publish(spark, target, load_id)
    remove_folder(spark, staging)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in the checkpoint, the same after every restart."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def _run(rows: DataFrame, target: str, checkpoint: str, fields: list[str]) -> StreamingQuery:
    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        absorb(batch, target, f"{_query_id(spark, checkpoint)}-{batch_id}", fields)
    q = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _stream(spark: SparkSession, source: str, schema: StructType, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source)


def ingest_dedup(spark: SparkSession, source: str, schema: StructType,
                 transform: Callable[[DataFrame], DataFrame], keys: list[str],
                 target: str, checkpoint: str, target_schema: StructType, remember: str = "1 hour",
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """L1: new files -> transform -> repeats within ``remember`` dropped by
    streaming state -> rows whose keys the index lacks are added to ``target``."""
    rows = transform(_stream(spark, source, schema, max_files_per_trigger)).withColumn(DIGEST, key_digest(keys))
    recent = rows.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, remember).dropDuplicatesWithinWatermark([DIGEST])
    return _run(recent.drop(ARRIVED), target, checkpoint, [f.name for f in target_schema.fields])


def ingest_anti_join(spark: SparkSession, source: str, schema: StructType,
                     transform: Callable[[DataFrame], DataFrame], keys: list[str],
                     target: str, checkpoint: str, target_schema: StructType,
                     max_files_per_trigger: int | None = None) -> StreamingQuery:
    """L2: per micro-batch, append only rows whose keys are not yet in ``target``.
    ``max_files_per_trigger`` bounds a batch."""
    rows = transform(_stream(spark, source, schema, max_files_per_trigger)).withColumn(DIGEST, key_digest(keys))
    return _run(rows, target, checkpoint, [f.name for f in target_schema.fields])


def read_target(spark: SparkSession, target: str, target_schema: StructType) -> DataFrame:
    """The rows of the published loads."""
    return LD.read_loads(spark, target, target_schema)


def compact_target(spark: SparkSession, target: str, target_schema: StructType) -> None:
    """Many small loads become one, in the table and in the index alike; loads
    published meanwhile stay beside it. ``vacuum_target`` drops what it replaced."""
    ids = LD.published(spark, target)
    if len(ids) < 2:
        return
    load_id = "compact-" + ids[-1]
    LD.write_load(LD.read_loads(spark, target, target_schema, ids=ids).hint("rebalance"), target, load_id)
    index = known_digests(spark, target, list(range(PREFIXES)), ids).withColumn(PREFIX, digest_prefix())
    LD.write_load(index.hint("rebalance", PREFIX).sortWithinPartitions(PREFIX, DIGEST), index_path(target), load_id, [PREFIX])
    LD.publish(spark, target, load_id, ids)


def vacuum_target(spark: SparkSession, target: str) -> None:
    """Drop the loads that compactions replaced, from the index and the table."""
    for load_id in LD.replaced(spark, target):
        remove_folder(spark, f"{index_path(target)}/{LD.LOAD}={load_id}")
    LD.vacuum(spark, target)
