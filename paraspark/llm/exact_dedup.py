"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Each step groups only the rows whose group in the step before held more than
one row, so most texts are told apart by two integers and the full digest is
computed only for rows that still share a length and a prefix hash with
another row. Built-in functions only. Groups are joined to one aggregated row
per key, never expanded into pairs; a key that holds a large part of the rows
collapses in the map-side aggregate and its side of the join is split by AQE.

Defined results: a NULL text counts as empty; texts are compared after each
run of white space becomes one space (no trimming); of equal texts the row
with the smallest id stays, a NULL id being larger than any other; repeated
rows (same id, same text) count each in ``group_size`` and exactly one of
them is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import WS, checkpointed, fresh, key_table, table, text_or_empty
from paraspark.plans.registry import register

#: Characters hashed by the second step (a parameter of the operator).
PREFIX_CHARS = 256


def normalised(text: str = "text"):
    return F.regexp_replace(text_or_empty(text), WS, " ")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row (counted map-side first)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per group of two or more equal rows: ``full_sha, keep_id,
    group_size``."""
    norm = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("t"))
    rows = rows.select("id", F.length("t").alias("len"), F.substring("t", 1, prefix_chars).alias("head"), "t")
    light = rows.select("len", F.xxhash64("head").alias("pre"))
    by_len, _ = key_table(_repeated(light, ["len"]))
    by_pre, fits = key_table(_repeated(light.join(by_len, "len", "left_semi"), ["len", "pre"]))
    rows = rows.withColumn("pre", F.xxhash64("head"))
    digest = F.sha2("t", 256).alias("full_sha")
    if fits:  # full content is read and hashed for the surviving rows only
        full = rows.join(by_pre, ["len", "pre"], "left_semi").select("id", digest)
    else:     # too many keys to broadcast: shuffle digests, never texts
        full = rows.select("id", "len", "pre", digest).join(by_pre, ["len", "pre"], "left_semi").select("id", "full_sha")
    return (full.groupBy("full_sha").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .filter("group_size > 1"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``."""
    groups, _ = key_table(duplicate_groups(docs, id_col, text_col))
    rows = (docs.select(F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
            .groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    j = rows.join(groups, rows.text_sha256 == groups.full_sha, "left")
    alone = F.col("full_sha").isNull()
    # repeated rows come back as often as they were given; the first one is kept
    j = j.select("id", "text_sha256", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                 F.coalesce("group_size", F.lit(1)).alias("group_size"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return j.select("id", "keep_id", "group_size",
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows ``exact_dedup`` drops, same columns."""
    dec = checkpointed(exact_dedup(docs, id_col, text_col))
    k_id, k_sha, sha = fresh(docs, "k_id", "k_sha", "row_sha")
    seen = (dec.groupBy(F.col("id").alias(k_id), F.col("text_sha256").alias(k_sha))
            .agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays")))
    gone, _ = key_table(seen.filter("NOT stays").select(k_id, k_sha))
    again, _ = key_table(seen.filter("stays AND n > 1").select(k_id, k_sha))
    same = F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(sha) == F.col(k_sha))
    left = docs.withColumn(sha, F.sha2(normalised(text_col), 256)).join(gone, same, "left_anti")
    if not again.isEmpty():  # repeated rows of a kept document: one of them stays
        once = left.join(again, same, "left_semi").dropDuplicates([id_col, sha])
        left = left.join(again, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""


@register("op2_exact_dedup", OP2_SQL)
def op2_exact_dedup(spark, d):
    """Every document with the document kept for its text."""
    return exact_dedup(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")
