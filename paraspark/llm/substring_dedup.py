"""Substring dedup: windows of 50 words that an earlier document also has.

1. Documents with the same word sequence form a class; every copy but the
   smallest id repeats it in full, so only that one goes on.
2. Count-min prefilter. Each 50-word window is filed under its anchor, the
   25-word gram of smallest hash inside it: equal windows have equal anchors,
   and consecutive windows mostly share theirs, so a document files about one
   anchor in thirteen words. Every partition counts the documents per anchor in
   a sketch; the sketches are merged, at most ``MERGE`` at a time, into one of
   a size set by the corpus and bounded by ``MAX_CELLS``. A merged count is
   never below the true one: a window whose anchor is not estimated to be in
   two documents is in one document only, and no repeated window is lost.
3. Second pass: the windows estimated repeated, and only these, are grouped
   exactly by a 128-bit hash (map-side minimum first). Windows of two or more
   documents are joined back; AQE can split the ones that very many share.
4. Each document drops the words covered by its marked windows.

A larger corpus than ``MAX_CELLS`` serves makes the estimate less selective
(more windows are grouped) and changes no result.

Defined results: a NULL or empty text has no words; a document of fewer than
50 words loses none; a row with a NULL id neither removes nor loses words; a
window repeated only inside its own document stays; repeated rows (same id)
do not remove each other and get one answer each, also where their texts
differ; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import WS, checkpointed, key_table, map_arrow, per_group, table, text_or_empty
from paraspark.plans.registry import register
from paraspark.session import remove_folder, shared_path

WINDOW = 50
#: Words of an anchor gram: half a window.
GRAM = 25
#: Sketch rows, and cells a row: the power of two above ``LOAD`` cells per
#: expected anchor, within the bounds (two bits of the estimate are sent out
#: per cell and row: at most 64 MB).
DEPTH = 2
LOAD = 4
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 28
#: Sketches merged by one task.
MERGE = 64
WORD_CACHE = 400_000
_BLOCK = 1 << 16

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_ROWS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> bytes:
        import xxhash
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h


_words = _WordHash()


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _STEP + b
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    return x ^ (x >> np.uint64(29))


def word_lanes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes per word."""
    return np.frombuffer(b"".join(map(_words.__getitem__, words)), np.uint64).reshape(-1, 2).T


def gram_hashes(lane: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, put together from runs whose
    lengths are powers of two."""
    n, acc, at, run, bit = len(lane) - size + 1, None, 0, lane, 1
    while True:
        if size & bit:
            part = run[at:at + n]
            acc = part if acc is None else _join(acc, part)
            at += bit
        if 2 * bit > size:
            return acc
        run, bit = _join(run[:-bit], run[bit:]), 2 * bit


def anchors(lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each window the position of its anchor."""
    grams = gram_hashes(lane, GRAM)
    span = WINDOW - GRAM + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    return grams, view.argmin(axis=1) + np.arange(len(view))


def cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    x = (grams ^ (grams >> np.uint64(31))) * _ROWS[row]
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _packed(counts_at: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted offsets in a block of cells, and their counts (saturated at 2)."""
    return zlib.compress(np.concatenate([counts_at.astype("<u2").view(np.uint8), np.minimum(counts, 2).astype(np.uint8)]).tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    n = len(raw) // 3
    return raw[:2 * n].view("<u2"), raw[2 * n:]


def _sketches(docs: DataFrame, bits: int) -> DataFrame:
    """One sparse sketch per partition: ``part, row, block, data``."""
    def run(batches):
        from pyspark import TaskContext
        seen: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]

        def squeeze(parts):  # sorted cells, each at most twice: a count of two is all that matters
            c = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int64)
            return [c[~((c == np.roll(c, 2)) & (np.arange(len(c)) > 1))]]

        held = 0
        for b in batches:
            for t in b.column(0):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(words) < WINDOW:
                    continue
                grams, at = anchors(word_lanes(words)[0])
                own = np.unique(grams[np.unique(at)])
                held += len(own)
                for r in range(DEPTH):
                    seen[r].append(cells(own, r, bits))
            if held > 2_000_000:
                seen, held = [squeeze(s) for s in seen], 0
        part = TaskContext.get().partitionId()
        for r in range(DEPTH):
            c, n = np.unique(squeeze(seen[r])[0], return_counts=True)
            block = c >> 16
            cuts = np.flatnonzero(np.diff(block)) + 1
            rows = [(int(c0[0] >> 16), _packed(c0 & 0xFFFF, n0)) for c0, n0 in zip(np.split(c, cuts), np.split(n, cuts)) if len(c0)]
            for i in range(0, len(rows), 256):
                some = rows[i:i + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(some), pa.int64()), pa.array([r] * len(some), pa.int32()),
                     pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.binary())],
                    names=["part", "row", "block", "data"])
    return map_arrow(docs.select("text"), run, "part LONG, row INT, block LONG, data BINARY")


def _merge(key, pdf):
    import pandas as pd
    total = np.zeros(_BLOCK, np.uint8)
    for data in pdf.data:
        at, n = _unpacked(data)
        total[at] = np.minimum(2, total[at] + n)
    at = np.flatnonzero(total)
    return pd.DataFrame({"part": [key[0]], "row": [key[1]], "block": [key[2]], "data": [_packed(at, total[at])]})


def repeated_cells(docs: DataFrame, bits: int) -> list[np.ndarray]:
    """Per sketch row one bit per cell: the merged count is two or more."""
    s = checkpointed(_sketches(docs, bits))
    last = s.agg(F.max("part")).first()[0]
    while last:  # at most MERGE sketches of a block meet in one task
        s = checkpointed(per_group(s.withColumn("part", F.expr(f"part div {MERGE}")), ["part", "row", "block"], _merge,
                                   "part LONG, row INT, block LONG, data BINARY"))
        last //= MERGE
    flags = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(DEPTH)]
    for r in s.select("row", "block", "data").toLocalIterator():  # the merged sketch: bounded by MAX_CELLS
        at, n = _unpacked(r.data)
        dense = np.zeros(_BLOCK, bool)
        dense[at[n >= 2]] = True
        flags[r.row][r.block * (_BLOCK // 8):(r.block + 1) * (_BLOCK // 8)] = np.packbits(dense)
    return flags


def _estimated_repeated(docs: DataFrame, flags, bits: int) -> DataFrame:
    """``h1, h2, doc_id, k, pos`` of the windows whose anchor the sketch
    estimates to be in two or more documents."""
    sent = docs.sparkSession.sparkContext.broadcast([f.tobytes() for f in flags])

    def run(batches):
        flag = [np.frombuffer(f, np.uint8) for f in sent.value]
        for b in batches:
            cols = [[], [], [], [], []]
            for doc_id, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(words) < WINDOW:
                    continue
                lanes = word_lanes(words)
                grams, at = anchors(lanes[0])
                used, back = np.unique(at, return_inverse=True)
                hit = np.ones(len(used), bool)
                for r in range(DEPTH):
                    c = cells(grams[used], r, bits)
                    hit &= (flag[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
                pos = np.flatnonzero(hit[back])
                if len(pos):
                    for col, v in zip(cols, (gram_hashes(lanes[0], WINDOW)[pos].view(np.int64), gram_hashes(lanes[1], WINDOW)[pos].view(np.int64),
                                             np.full(len(pos), doc_id), np.full(len(pos), k), pos)):
                        col.append(v)
                if sum(map(len, cols[4])) > 200_000:
                    yield _batch(cols)
                    cols = [[], [], [], [], []]
            if cols[0]:
                yield _batch(cols)

    def _batch(cols):
        arrays = [pa.array(np.concatenate(c)) for c in cols[:4]] + [pa.array(np.concatenate(cols[4]).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "doc_id", "k", "pos"])
    return map_arrow(docs.select("doc_id", "k", "text"), run, "h1 LONG, h2 LONG, doc_id LONG, k LONG, pos INT")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, k, starts`` of the documents with windows that also start in
    a document of smaller id. ``docs``: ``doc_id, k`` (of the text), ``text``."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # about one anchor per 13 words of 6 bytes or more
    want = LOAD * size // (6 * (WINDOW - GRAM + 2) // 2) + 1
    bits = int(min(max(want, MIN_CELLS), MAX_CELLS) - 1).bit_length()
    spark = docs.sparkSession
    # both readers of the windows read them as written; the texts are hashed once
    folder = shared_path(spark, f"windows-{uuid.uuid4().hex}")
    _estimated_repeated(docs, repeated_cells(docs, bits), bits).write.parquet(folder)
    windows = spark.read.parquet(folder)
    first = checkpointed(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
                         .filter("first_id < last_id").select("h1", "h2", "first_id"))
    late = windows.join(first, ["h1", "h2"]).filter("doc_id > first_id")
    marked = checkpointed(late.groupBy("doc_id", "k").agg(F.collect_set("pos").alias("starts")))
    remove_folder(spark, folder)
    return marked


def _result(rows: DataFrame, with_text: bool) -> DataFrame:
    schema = "doc_id LONG, n_words LONG, n_removed LONG, kept_sha256 STRING" + (", kept_text STRING" if with_text else "")

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for t, copy, starts in zip(b.column(1), b.column(2).to_pylist(), b.column(3)):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                keep = words
                if copy and n >= WINDOW:
                    keep = []
                elif starts.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.asarray(starts.values, np.int64)
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                    keep = [w for w, gone in zip(words, np.cumsum(edge[:-1]) > 0) if not gone]
                text = b" ".join(keep)
                for col, v in zip(out, (n, n - len(keep), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass"))):
                    col.append(v)
            arrays = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(out[3], pa.string())] if with_text else []),
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)
    return map_arrow(rows, run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` and,
    with ``with_text``, the text that stays."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("k"), F.col(text_col).alias("text"))
    keyed = d.filter("doc_id IS NOT NULL")
    same = keyed.select("doc_id", "k", F.md5(F.trim(F.regexp_replace(text_or_empty("text"), WS, " "))).alias("sequence"))
    classes, _ = key_table(same.groupBy("sequence").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
                           .filter("first_id < last_id").select("sequence", "first_id"))
    copies, fits = key_table(same.join(classes, "sequence").filter("doc_id > first_id").select("doc_id", "k").distinct())
    # too many copies to broadcast: they go through the windows like any other, with the same result
    once = keyed.join(copies, ["doc_id", "k"], "left_anti") if fits else keyed
    late = repeated_windows(once)
    marks = late.select("doc_id", "k", F.lit(False).alias("copy"), F.col("starts"))
    if fits:
        marks = marks.unionByName(copies.select("doc_id", "k", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts")))
    rows = d.join(marks, ["doc_id", "k"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts")
    return _result(rows, with_text)


@register("op4_countmin_substring_dedup")
def op4_countmin_substring_dedup(spark, d):
    """Words each document loses to windows of earlier documents."""
    return remove_repeats(table(spark, d, "documents"), with_text=False)
