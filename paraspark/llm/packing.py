"""Packing by the sum-of-squares rule into fixed windows.

Every scan partition is packed on its own, in one pass and without a shuffle:
documents arrive one by one, each is cut into full windows and a remainder,
and the remainder goes to the fill level that minimises the sum of squared
counts of partially filled windows (ties: the fullest level), which a level
array keeps. At most ``max_open`` windows are open at a time; beyond that a
remainder is cut to fill the fullest open windows. When the partition ends its
open windows are joined, the emptiest filling the fullest, so that at most one
window per partition is padded. A task's memory is the open windows, whatever
the partition's size; a lost task is repeated with the same result.

Defined results: a NULL or empty text is one end id; a NULL document id is
carried; repeated rows are packed each on their own; every id lies in exactly
one piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm import tokens
from paraspark.llm.common import map_arrow, table
from paraspark.plans.registry import register

WINDOW = 4096
END_ID = 2
MAX_OPEN = 4096
#: Chunk cache where a worker does nothing but pack (the pipeline's workers
#: hold other stages' memory too and keep the smaller default).
PACK_CACHE = 1_600_000

SCHEMA = "doc_id LONG, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, sequence_id LONG, offset LONG"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Online packer of one partition; ``emit`` receives finished windows as
    lists of pieces ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, window: int, max_open: int, emit):
        self.w, self.max_open, self.emit = window, max_open, emit
        self.count = np.zeros(window + 1, np.int64)         # open windows per fill level
        self.open: dict[int, list[list]] = {}               # level -> windows at that level
        self.n_open = 0

    def _level(self, size: int) -> int:
        """The level (0: a new window) whose use adds least to the sum of squares."""
        h = np.flatnonzero(self.count[1:self.w - size + 1]) + 1
        new = 2 * self.count[size] + 1
        if not len(h):
            return 0
        add = 2 - 2 * self.count[h] + 2 * self.count[h + size]
        if h[-1] + size == self.w:
            add[-1] = 1 - 2 * self.count[h[-1]]             # a full window is no longer counted
        best = len(add) - 1 - int(np.argmin(add[::-1]))     # ties: the fullest level
        return int(h[best]) if add[best] <= new else 0

    def _take(self, level: int) -> list:
        windows = self.open[level]
        out = windows.pop()
        if not windows:
            del self.open[level]
        self.count[level] -= 1
        self.n_open -= 1
        return out

    def _put(self, level: int, pieces: list) -> None:
        if level == self.w:
            self.emit(pieces)
            return
        self.open.setdefault(level, []).append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.w:
            self.emit([(doc_id, at, ids[at:at + self.w], n)])
            at += self.w
        while at < n:
            size = n - at
            level = self._level(size)
            if not level and self.n_open >= self.max_open:  # full: cut into the fullest open window
                level = max(self.open)
                size = min(size, self.w - level)
            pieces = self._take(level) if level else []
            pieces.append((doc_id, at, ids[at:at + size].copy(), n))
            self._put(level + size, pieces)
            at += size

    def close(self) -> None:
        """Join the open windows: the emptiest ones fill the fullest."""
        left = [(level, p) for level in sorted(self.open) for p in self.open[level]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        spare: list = []                                    # pieces of the window being taken apart
        while left or spare:
            level, window = left.pop() if left else (0, [])
            while level < self.w and (spare or left):
                if not spare:
                    spare = left.pop(0)[1]
                doc_id, start, ids, n = spare.pop()
                fit = min(self.w - level, len(ids))
                window.append((doc_id, start, ids[:fit], n))
                level += fit
                if fit < len(ids):
                    spare.append((doc_id, start + fit, ids[fit:], n))
            self.emit(window)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None,
         window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN,
         cache_entries: int = tokens.CACHE_ENTRIES) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Sequence ids are unique, not dense: the partition
    number in the high bits, a counter in the low 40. ``cache_entries`` bounds
    the worker's cache of tokenised chunks (speed and memory only)."""
    path = vocab or tokens.default_path()

    def run(batches):
        ids_of = tokens.shared(path, cache_entries)
        base = TaskContext.get().partitionId() << 40
        rows: list[list] = [[] for _ in FIELDS]
        n_seq = 0

        def emit(pieces):
            nonlocal n_seq
            offset = 0
            for doc_id, start, ids, n in pieces:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                for col, v in zip(rows, (doc_id, start, len(ids), crc, n, base + n_seq, offset)):
                    col.append(v)
                offset += len(ids)
            n_seq += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=list(FIELDS))
            for c in rows:
                c.clear()
            return out

        packer = Packer(window, max_open, emit)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(doc_id, ids_of.array(text.as_py(), end_id))
                if len(rows[0]) >= 20_000:
                    yield flush()
        packer.close()
        if rows[0]:
            yield flush()

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, SCHEMA)


@register("op3_sum_of_squares_packing")
def op3_sum_of_squares_packing(spark, d):
    """All documents packed into windows of at most 4096 ids."""
    return pack(table(spark, d, "documents"), cache_entries=PACK_CACHE)
