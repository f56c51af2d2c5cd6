import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paraspark.llm import hard_negatives as H
from paraspark.llm import segments as SG


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows],
                                 "vec_id LONG, embedding ARRAY<FLOAT>, label INT, score STRING, dim INT")


def brute(rows, every=100, scale=256):
    ok = [(i, np.floor(scale * np.array(v, np.float32).astype(float)).astype(object).tolist(), lab) for i, v, lab in rows
          if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, lab in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for i, (lab, v) in anchors.items():
        s = [(-int(sum(int(a) * int(b) for a, b in zip(v, w))), j, m == lab) for j, w, m in ok if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in s if x[2])[:5]:
            hard = sorted(x for x in s if not x[2] and -80 * p <= -100 * x[0] <= -100 * p)[:5]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(hard)]
    return sorted(out)


def mined(spark, rows):
    return sorted(map(tuple, H.mine(frame(spark, rows), lambda i: i % 100 == 0, F.col("label")).collect()))


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0.05, 0.3, 12).tolist(), int(i % 3)) for i in range(-300, 700)]
    rows += [(1000 + i, [0.5] * 12, i % 2) for i in range(120)] + [(800, [9.0] * 12, 1), (700, None, 1), (900, [], 1), (1200, [0.1, None], 1),
             (1300, [float("nan")] * 12, 1), (None, [0.5] * 12, 1), (1400, [0.2] * 12, None), (1500, [0.3, 0.2], 1), (1501, [0.1, 0.9], 1),
             (1502, [0.1, 0.8], 2), (1600, [1.0], 5), (100, [0.1] * 12, 0), (100, [0.1] * 12, 0), (55, [0.5] * 12, 2), (55, [0.5] * 12, 2)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_many_blocks_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(SG, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(SG, "SLICE_LEAST", 40)
    rng = np.random.default_rng(2)
    rows = [(i * 20, (rng.normal(0, 0.2, 20) + 0.1).tolist(), 7 if i % 2 else int(rng.integers(0, 40))) for i in range(400)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_products_beyond_doubles(spark):
    rows = [(i, [1e6 + i, 1e6 - i, 1.0 * i], i % 2) for i in range(0, 60)] + [(100, [2e6, 1e6, 3.0], 0)]
    want = brute(rows)
    assert max(abs(r[4]) for r in want) > 2**53 and mined(spark, rows) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(16, 70), st.integers(0, 10**6))
def test_bounds_hold_the_score(dim, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(-300, 300, (6, dim)).astype(float), rng.integers(-300, 300, (9, dim)).astype(float)
    for s in SG.levels(dim):
        (am, ad), (bm, bd) = SG.summary(x, s), SG.summary(y, s)
        assert (am @ bm.T + ad @ bd.T + 0.5 >= x @ y.T).all() and (am @ bm.T - ad @ bd.T - 0.5 <= x @ y.T).all()


def test_clustered_vectors_are_mostly_pruned():
    """Vectors that are smooth along their components: the bounds drop most pairs before an exact product."""
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(0, 100, (12, 8)), 8, axis=1)
    labels = rng.integers(0, 12, 3000)
    x = np.rint(centres[labels] + rng.normal(0, 3, (3000, 64)))
    ids = np.arange(3000)
    a = ids % 100 == 0
    p = np.sort(np.where((labels[a][:, None] == labels) & (ids[a][:, None] != ids), x[a] @ x.T, -1e18), axis=1)[:, :-6:-1].astype(np.int64)
    low = -(-80 * p // 100)
    block = SG.Block(ids[a], labels[a], x[a], low, p, 5, False)
    for i in range(0, 3000, 500):
        block.meet(ids[i:i + 500], labels[i:i + 500], x[i:i + 500])
    got = {(r["anchor_id"], r["band"], r["vec_id"], r["score"]) for r in block.found().to_pylist()}
    want = set()
    for r, i in enumerate(ids[a]):
        s = (x[i] @ x.T).astype(np.int64)
        for j in range(5):
            fit = np.flatnonzero((labels != labels[i]) & (s >= low[r, j]) & (s <= p[r, j]))
            want |= {(i, j, v, s[v]) for v in sorted(fit, key=lambda v: (-s[v], v))[:5]}
    assert got == want
    assert block.exact < block.pairs / 2
