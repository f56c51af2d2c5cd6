"""Corpus pipeline: documents -> packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read back as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paraspark.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from paraspark.llm.common import checkpointed, table
from paraspark.plans.registry import QUERIES, register
from paraspark.session import remove_folder, shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component (similarity 0.80 or more) the smallest
    id stays."""
    return near_dedup.keep_representatives(docs, rule=near_dedup.LINK_80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture takes them (a leaf short of
    tokens repeats them in a second epoch)."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 4096 token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, near-duplicate links and tokenizer are not expressible in SQL;
#: tests/llm/test_pipeline.py replays the stages in plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written under the
    shared checkpoint folder and read back, and its folder goes once the next
    stage has read it."""
    docs = table(spark, sf_dir, "documents")
    base = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if last:
            remove_folder(spark, f"{base}/{last}")
        last = name
    out = checkpointed(docs)
    remove_folder(spark, base)
    return out


if "pipeline" not in QUERIES:  # the file may be loaded under more than one name
    register("pipeline", ORACLE_SQL)(run)
