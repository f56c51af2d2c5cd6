"""Token ids of all documents as files of range-coded blocks, and back.

Documents are range-partitioned and sorted by id, tokenised, and each
partition's ids are cut into blocks of whole documents (about ``BLOCK_IDS``
ids; a longer document is a block of its own). A file is a Parquet file of
block rows: where the block stands, the documents in it, their lengths, and
the coded bytes of ``range_coder`` with two checksums. Spark's committer writes
them, so a lost task leaves no half file; any block can be read on its own.

Defined results: a NULL or empty text is its end id alone; NULL ids come
first; rows that share an id follow each other by text, each with its own
lengths; an empty table gives empty files and an empty result; a damaged block
raises; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraspark.llm import packing, range_coder, tokens
from paraspark.llm.common import checkpointed, map_arrow, table
from paraspark.plans.registry import register
from paraspark.session import remove_folder, shared_path

END_ID = 2
BLOCK_IDS = 1 << 20
#: Ids a task codes or decodes at a time (a block beyond it alone).
WAVE_IDS = 1 << 20

BLOCK_SCHEMA = "part LONG, block LONG, first LONG, n_ids LONG, doc_ids ARRAY<LONG>, doc_lengths ARRAY<INT>, data BINARY"


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = END_ID,
            block_ids: int = BLOCK_IDS, wave_ids: int = WAVE_IDS) -> DataFrame:
    """Block rows of the documents in ascending id order."""
    path = vocab or tokens.default_path()

    def run(batches):
        from pyspark import TaskContext
        ids_of, part = tokens.shared(path, packing.PACK_CACHE), TaskContext.get().partitionId()
        done = {"blocks": 0, "ids": 0}
        blocks: list[tuple[list, list, list]] = []   # (ids, document ids, lengths) of the blocks being filled
        held = filled = 0                            # ids held, and in the last block

        def coded():
            data = range_coder.encode_blocks([np.concatenate(b[0]) for b in blocks])
            for i in range(0, len(blocks), 64):
                rows = blocks[i:i + 64]
                size = [sum(b[2]) for b in rows]
                first = done["ids"] + np.concatenate(([0], np.cumsum(size)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.int64()), pa.array(range(done["blocks"], done["blocks"] + len(rows)), pa.int64()),
                     pa.array(first[:-1], pa.int64()), pa.array(size, pa.int64()), pa.array([b[1] for b in rows], pa.list_(pa.int64())),
                     pa.array([b[2] for b in rows], pa.list_(pa.int32())), pa.array(data[i:i + 64], pa.binary())],
                    names=["part", "block", "first", "n_ids", "doc_ids", "doc_lengths", "data"])
                done["blocks"] += len(rows)
                done["ids"] = int(first[-1])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), ids_of.arrays(b.column(1), end_id)):
                if not blocks or filled + len(ids) > block_ids:
                    if held >= wave_ids:
                        yield from coded()
                        blocks, held = [], 0
                    blocks.append(([], [], []))
                    filled = 0
                for kept, v in zip(blocks[-1], (ids, doc_id, len(ids))):
                    kept.append(v)
                held += len(ids)
                filled += len(ids)
        if blocks:
            yield from coded()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"), run, BLOCK_SCHEMA)


def decoded(files: DataFrame) -> DataFrame:
    """``doc_id, part, first, at, n_tokens, ids_crc32`` of every document read
    back: ``at`` counts the ids before it in its block."""
    def waves(b):
        """Slices of a batch, of as many blocks as are decoded at a time."""
        at = held = 0
        for i, n in enumerate(b.column(2).to_pylist()):
            if i > at and held + n > WAVE_IDS:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)

    def run(batches):
        for b in (w for batch in batches for w in waves(batch)):
            blocks = range_coder.decode_blocks(b.column(5).to_pylist())
            rows = [[], [], [], [], [], []]
            for part, first, doc_ids, lengths, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(),
                                                          b.column(4).to_pylist(), blocks):
                at = 0
                for doc_id, n in zip(doc_ids, lengths):
                    for col, v in zip(rows, (doc_id, part, first, at, n, zlib.crc32(ids[at:at + n].tobytes()))):
                        col.append(v)
                    at += n
                if at != len(ids):
                    raise ValueError("block and document lengths differ")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows],
                                             names=["doc_id", "part", "first", "at", "n_tokens", "ids_crc32"])
    return map_arrow(files.select("part", "first", "n_ids", "doc_ids", "doc_lengths", "data"), run,
                     "doc_id LONG, part LONG, first LONG, at LONG, n_tokens LONG, ids_crc32 LONG")


def write_ids(docs: DataFrame, path: str, **params) -> None:
    encoded(docs, **params).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files alone; ``start``
    counts the ids of all documents before it."""
    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row per file partition: its ids, and those of the partitions before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
             .select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before")))
    return (decoded(files).join(F.broadcast(parts), "part")  # one row per writing task
            .select("doc_id", (F.col("before") + F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


@register("op6_context_mixing_token_files")
def op6_context_mixing_token_files(spark, d):
    """All documents' ids written as coded files and read back."""
    path = shared_path(spark, f"token-ids-{uuid.uuid4().hex}")
    write_ids(table(spark, d, "documents"), path)
    out = checkpointed(read_documents(spark, path))
    remove_folder(spark, path)
    return out
