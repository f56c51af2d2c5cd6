"""Bounded inner-product search by segment statistics (shared by the top-k
search and the hard-negative mining).

A vector is summarised, coarse to fine, by the mean and deviation of its
segments. With ``M`` the summed products of means and ``D`` of deviations (both
times the segment length), ``M - D <= score <= M + D``. A pair whose bounds lie
outside what its anchor can still use drops out at the first level that shows
it; the exact product is taken of the pairs that are left. What an anchor can
use shrinks as rows come by: the k-th score found so far in each of its bands.

A search is one shuffle and one scan of its rows: anchors are dealt into blocks
of bounded size, candidates into slices, every (block, slice) group reads its
anchors first and then streams candidates in chunks, and returns at most ``k``
rows per anchor and band. No task holds more than one block of anchors and one
chunk of candidates.

Refining stops when a level drops less than ``WORTH`` of a chunk's pairs:
vectors whose energy is spread evenly over all components (as isotropic noise)
cannot be told apart by segment statistics, and the exact product is cheaper
than finer bounds. The results do not depend on it. Scores are 64-bit integers,
exact while the sum of products stays below 2^63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraspark.llm.common import map_arrow

#: Anchors of a task; candidates compared at once; candidates of a slice (at
#: most, and at least while there are fewer slices than shuffle partitions).
ANCHOR_BLOCK, CHUNK = 4096, 1024
SLICE_MOST, SLICE_LEAST = 1 << 16, 1 << 11
#: Segments per level; none shorter than this many components.
LEVELS = (4, 8, 16)
LEAST_SEGMENT = 4
WORTH = 0.1
FAR = (1 << 63) - 1


def vectors(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """``vec_id, label, dim, v`` (whole numbers as doubles) of the rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return (rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & (F.size(v) > 0)).filter(~bad)
            .select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                    F.size(v).alias("dim"), whole.alias("v")))


def summary(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, both times the root of the
    segment's length."""
    cuts = np.linspace(0, m.shape[1], segments + 1).astype(int)
    width = np.diff(cuts)
    mean = np.add.reduceat(m, cuts[:-1], axis=1) / width
    square = np.add.reduceat(m * m, cuts[:-1], axis=1) / width
    root = np.sqrt(width)
    return mean * root, np.sqrt(np.maximum(square - mean * mean, 0)) * root


def levels(dim: int) -> list[int]:
    return [s for s in LEVELS if s * LEAST_SEGMENT <= dim]


class Block:
    """Anchors of one task and the best partners found so far per band.

    ``low`` and ``high``: anchors x bands, the scores a band accepts.
    """

    def __init__(self, ids, labels, x, low, high, k: int, same_label: bool):
        self.ids, self.labels, self.x, self.low, self.high = ids, labels, x, low.copy(), high
        self.k, self.same = k, same_label
        self.summaries = [summary(x, s) for s in levels(x.shape[1])]
        self.best = [(np.empty(0, np.int64),) * 3 for _ in range(low.shape[1])]  # anchor row, vec_id, score
        self.exact = self.pairs = 0

    def meet(self, ids, labels, y) -> None:
        """One chunk of candidates."""
        alive = (self.labels[:, None] == labels) == self.same
        alive &= self.ids[:, None] != ids
        low, high = self.low.min(axis=1), self.high.max(axis=1)
        alive &= (low <= high)[:, None]
        left = self.pairs_now = int(alive.sum())
        self.pairs += left
        for (a_mean, a_dev), segments in zip(self.summaries, levels(self.x.shape[1])):
            if not left:
                return
            mean, dev = summary(y, segments)
            mid, wide = a_mean @ mean.T, a_dev @ dev.T
            wide += 0.5 + 1e-9 * (np.abs(mid) + wide)  # rounding of the bounds themselves
            alive &= (mid + wide >= low[:, None]) & (mid - wide <= high[:, None])
            now = int(alive.sum())
            stop, left = now > (1 - WORTH) * left, now
            if stop:
                break
        if left:
            r, c, s = self.products(alive, left, y)
            self.keep(r, ids[c], s, low, high)

    def products(self, alive, left, y):
        """Exact scores of the pairs left."""
        self.exact += left
        small = np.abs(self.x).max(initial=0) * np.abs(y).max(initial=0) * y.shape[1] < 2.0 ** 53
        kind = np.float64 if small else np.int64  # doubles hold whole numbers below 2^53
        x, y = self.x.astype(kind, copy=False), y.astype(kind, copy=False)
        if left * 16 < alive.size:
            r, c = np.nonzero(alive)
            s = np.concatenate([np.einsum("ij,ij->i", x[r[i:i + 65536]], y[c[i:i + 65536]]) for i in range(0, left, 65536)])
        else:
            score = x @ y.T
            score[~alive] = bottom = -np.inf if small else np.iinfo(np.int64).min
            take = np.zeros(alive.shape, bool)
            for j in range(self.low.shape[1]):
                fits = (score >= self.low[:, j, None]) & (score <= self.high[:, j, None]) & (score > bottom)
                if self.k < len(y) and np.count_nonzero(fits) > 4 * self.k * len(x):
                    # of many that fit only those not under the chunk's k-th can be among the best
                    m = np.where(fits, score, bottom)
                    fits &= m >= np.partition(m, len(y) - self.k, axis=1)[:, len(y) - self.k, None]
                take |= fits
            r, c = np.nonzero(take)
            s = score[r, c]
        return r, c, s.astype(np.int64)

    def keep(self, r, ids, s, low, high) -> None:
        for j in range(self.low.shape[1]):
            fits = (s >= self.low[r, j]) & (s <= self.high[r, j])
            if not fits.any():
                continue
            rows, vec, score = (np.concatenate([old, new[fits]]) for old, new in zip(self.best[j], (r, ids, s)))
            order = np.lexsort((vec, -score, rows))
            rows, vec, score = rows[order], vec[order], score[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            top = rank < self.k
            self.best[j] = rows[top], vec[top], score[top]
            last = rank == self.k - 1
            self.low[rows[last], j] = score[last]

    def found(self) -> pa.RecordBatch:
        rows = np.concatenate([b[0] for b in self.best])
        band = np.repeat(np.arange(len(self.best)), [len(b[0]) for b in self.best])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[rows]), pa.array(band.astype(np.int32)), pa.array(np.concatenate([b[1] for b in self.best])),
                                           pa.array(np.concatenate([b[2] for b in self.best]))], names=["anchor_id", "band", "vec_id", "score"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def search(batches, k: int, same_label: bool):
    """Rows sorted by block and slice, anchors first. ``bounds`` of an anchor:
    its bands' low and high scores in turn."""
    key, block, anchors = None, None, []

    def opened():
        ids, labels, x, bounds = (np.concatenate(p) for p in zip(*anchors))
        return Block(ids, labels, x, bounds[:, 0::2], bounds[:, 1::2], k, same_label)

    for b in batches:
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)  # dim, block, slice, kind
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(keys)]):
            dim, at, part, kind = keys[start].tolist()
            if key != (dim, at, part):
                if block:
                    yield block.found()
                key, block, anchors = (dim, at, part), None, []
            rows = b.slice(start, end - start)
            ids, labels = (rows.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            if kind == 0:
                n = len(rows.column(7)[0])
                anchors.append((ids, labels, _matrix(rows.column(6), dim), rows.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)))
                continue
            if block is None and anchors:
                block = opened()
            for i in range(0, len(ids) if block else 0, CHUNK):
                block.meet(ids[i:i + CHUNK], labels[i:i + CHUNK], _matrix(rows.column(6).slice(i, CHUNK), dim))
    if block:
        yield block.found()


def slices_of(n: int, tasks: int) -> int:
    """Slices for ``n`` candidates: all tasks have work, none more than ``SLICE_MOST`` rows a block."""
    return max(1, -(-n // SLICE_MOST), min(tasks, -(-n // SLICE_LEAST)))


def dealt(anchors: DataFrame, candidates: DataFrame, k: int, same_label: bool, slices: int, tasks: int) -> DataFrame:
    """``anchor_id, band, vec_id, score``: at most ``k`` per anchor, band and
    slice. ``anchors`` carry their ``block`` and ``bounds``, ``candidates``
    their ``blocks``."""
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    a = anchors.select("dim", "block", each.alias("slice"), F.lit(0).alias("kind"), "vec_id", "label", "v", "bounds")
    c = candidates.select("dim", F.explode("blocks").alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).cast("int").alias("slice"),
                          F.lit(1).alias("kind"), "vec_id", "label", "v", F.array().cast("array<long>").alias("bounds"))
    at = ["dim", "block", "slice"]
    rows = a.unionByName(c).repartition(tasks, *at).sortWithinPartitions(*at, "kind")
    return map_arrow(rows, lambda batches: search(batches, k, same_label), "anchor_id LONG, band INT, vec_id LONG, score LONG")


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
