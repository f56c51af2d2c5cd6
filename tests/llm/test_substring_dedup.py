import hashlib
import random

import numpy as np

from paraspark.llm import substring_dedup as S
from tests.llm.helpers import docs, parquet_rows


def brute(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - 49):
                k = tuple(w[p:p + 50])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for p in range(len(w) - 49):
                if first[tuple(w[p:p + 50])] < i:
                    gone[p:p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(map(str, out))


def run(spark, rows):
    return sorted(str(tuple(r)) for r in S.remove_repeats(docs(spark, rows, extra=True)).collect())


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(100_000)}" for _ in range(n)]


def cases():
    a, b = words(1, 400), words(2, 120)
    return [(5, " ".join(a)), (3, " ".join(b + a[100:160] + b[::-1])), (9, "\t".join(a)), (4, " ".join(a[:49])), (6, " ".join(a[:50])),
            (7, " ".join(words(3, 60) + a[200:250] + a[230:290])), (8, " ".join(b[:60] + b[:60])), (10, None), (11, ""), (12, " \n"),
            (13, " ".join(b[:80] + b[:80])), (None, " ".join(a)), (20, " ".join(words(4, 55))), (20, " ".join(words(4, 55))),
            (30, " ".join(["same"] * 200)), (31, " ".join(["same"] * 90)), (40, " ".join(words(5, 20_000) + b[10:70]))]


def test_edge_cases_against_brute_force(spark):
    assert run(spark, cases()) == brute(cases())


def test_documents_against_brute_force(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in parquet_rows(spark, sf_small, "documents").collect()]
    assert run(spark, rows) == brute(rows)


def test_a_saturated_sketch_changes_nothing(spark, monkeypatch):
    """One cell block for everything: all windows are estimated repeated."""
    monkeypatch.setattr(S, "MAX_CELLS", 1 << 16)
    monkeypatch.setattr(S, "cells", lambda grams, row, bits: np.zeros(len(grams), np.int64))
    assert run(spark, cases()) == brute(cases())


def test_sketches_merge_in_levels(spark, monkeypatch):
    monkeypatch.setattr(S, "MERGE", 2)
    d = docs(spark, cases()).selectExpr("doc_id", "xxhash64(text) AS k", "text").filter("doc_id IS NOT NULL").repartition(7)
    flags = S.repeated_cells(d, 16)
    grams = []
    for _, t in cases():
        w = (t or "").encode().split()
        if len(w) >= 50:
            g, at = S.anchors(S.word_lanes(w)[0])
            grams.append(np.unique(g[at]))
    all_grams, n = np.unique(np.concatenate(grams), return_counts=True)
    for r in range(S.DEPTH):  # never below the true count
        c = S.cells(all_grams[n >= 2], r, 16)
        assert ((flags[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1).all()


def test_without_broadcast_of_copies(spark, monkeypatch):
    from paraspark.llm import common
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert run(spark, cases()) == brute(cases())


def test_empty(spark):
    assert run(spark, []) == []


def test_gram_hashes_depend_on_all_words_in_order():
    lane = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = S.gram_hashes(lane, 50)
    assert len(h) == 150
    for j in range(50):
        other = lane[:50].copy()
        other[j] ^= np.uint64(1)
        assert S.gram_hashes(other, 50)[0] != h[0]
    assert S.gram_hashes(lane[20:70], 50)[0] == h[20]
