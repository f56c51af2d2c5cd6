"""Grouping by digests of long keys (F6, F13, G3, G7; the ingest's keys).

A key of whole texts is compared by the SHA-256 of its fields: 32 bytes go
through the shuffle in its place, whatever the texts' lengths, and collapse
map-side. Two different keys share a digest with probability about 2^-128 even
at 10^12 keys; on top of that every group is held against an independent
64-bit hash of the same fields, and a query whose group holds two different
ones fails instead of merging them. Texts are read again only for the groups
that a result names: the groups are written once and counted, up to
``BROADCAST_ROWS`` of them (20 MB) are broadcast to the rows, and with a row key
one row per group is fetched, so no text is shuffled; beyond that the join
shuffles.

NULL fields are equal to each other and differ from ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark.session import ensure_checkpoint_dir

DIGEST = "_digest"
#: Groups (a digest or row key, and a count) that are broadcast at most.
BROADCAST_ROWS = 300_000


def key_digest(keys: list[str]) -> Column:
    """SHA-256 of the fields, each behind its length (NULL has a sign of its own)."""
    def field(k):
        c = F.col(k).cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[field(k) for k in keys]), 256))


def digest_groups(df: DataFrame, keys: list[str], row_key: str | None = None) -> DataFrame:
    """(_digest, n[, _row]): rows per distinct key, and the least ``row_key``."""
    rows = df.select(key_digest(keys).alias(DIGEST), F.xxhash64(*keys).alias("_other"), *([F.col(row_key).alias("_row")] if row_key else []))
    groups = rows.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("n"), F.min("_other").alias("_lo"), F.max("_other").alias("_hi"),
                                      *([F.min("_row").alias("_row")] if row_key else []))
    checked = F.when(F.col("_lo") == F.col("_hi"), F.col("n")).otherwise(F.raise_error(F.lit("two keys share a SHA-256 digest")))
    return groups.select(DIGEST, checked.cast("long").alias("n"), *(["_row"] if row_key else []))


def repeated_keys(df: DataFrame, keys: list[str], name: str = "occurrences", row_key: str | None = None) -> DataFrame:
    """(keys..., ``name``): keys that occur more than once.

    ``row_key``: a unique, non-null column of ``df`` by which the key of each
    group is fetched from one of its rows."""
    ensure_checkpoint_dir(df.sparkSession)
    found = digest_groups(df, keys, row_key).filter("n > 1").checkpoint(eager=True)
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    if row_key:
        named = found.select(F.col("_row").alias(row_key), F.col("n").alias(name))
        return df.select(row_key, *keys).join(named, row_key).select(*keys, name)
    rows = df.withColumn(DIGEST, key_digest(keys)).select(DIGEST, *keys).join(found, DIGEST)
    return rows.groupBy(DIGEST).agg(F.first(F.struct(*keys)).alias("_k"), F.first("n").alias(name)).select(*[F.col("_k")[k].alias(k) for k in keys], name)
