import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paraspark.llm import lexical_search as L
from tests.llm.helpers import docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(rows, items, k=20):
    counted = [(i, Counter(words(t))) for i, t in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    one = {}
    for i, t in items:
        if i is not None:
            one[i] = min(one.get(i, t or ""), t or "")
    for item, text in one.items():
        scores = []
        for i, c, n in counted:
            m = 75 + 25 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def searched(spark, rows, items):
    it = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id LONG, text STRING, rank STRING")
    return sorted(map(tuple, L.top_documents(docs(spark, rows, extra=True), it).collect()))


def corpus(seed, n, longest=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "naïve", "ñ", "日本", "A1", "x"]
    return [" ".join(r.choices(vocab, weights=[1 / (i + 1) for i in range(len(vocab))], k=r.randrange(longest))) for _ in range(n)]


HARD = [(None, "w0 w1 w2 only here"), (500, None), (501, ""), (502, " .,;\n"), (503, "w1 " * 30_000 + "w2"), (504, "w7 W7 w7!"), (504, "w7 W7 w7!"), (505, "w7 w7 w7"),
        (506, "a_b a-b A@B [x] {y} ~ ` \x7f z\x00q")]


def test_against_brute_force(spark):
    rows = list(enumerate(corpus(1, 150))) + HARD
    items = list(enumerate(corpus(2, 30, 25))) + [(30, "w3 w3 w3 w7 W7"), (31, None), (32, ""), (None, "w1"), (33, "unseen terms"), (34, "w3 w3 w3 w7 w7"),
                                                  (35, "z q a b É"), (35, "w9"), (36, " ".join(f"w{i}" for i in range(40)) * 3)]
    want = brute(rows, items)
    assert len(want) > 300 and searched(spark, rows, items) == want


def test_many_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(L, "BLOCK_TERMS", 60)
    rows, items = list(enumerate(corpus(3, 60))), list(enumerate(corpus(4, 40, 20)))
    assert searched(spark, rows, items) == brute(rows, items)


def test_empty(spark):
    assert searched(spark, [], [(1, "a b")]) == []
    assert searched(spark, [(1, "a b")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 9), st.integers(1, 3), max_size=8), max_size=8), st.integers(0, 10**6))
def test_the_graph_adds_up_to_the_items(items, seed):
    graph = L.share(items)
    parts = np.random.default_rng(seed).integers(0, 10**9, (10, 5))
    want = [sum((n * parts[t] for t, n in terms.items()), np.zeros(5, np.int64)) for terms in items]
    got = L.evaluate(graph, parts)
    assert len(got) == len(items) and all((a == b).all() for a, b in zip(got, want))


def test_shared_sets_are_computed_once():
    """Thirty items over four overlapping sets take far fewer additions than term by term."""
    r = random.Random(6)
    sets = [range(i * 15, i * 15 + 30) for i in range(4)]
    items = [{t: 1 for s in r.sample(sets, 2) for t in s} | {100 + j: 1} for j in range(30)]
    assert L.share(items).edges < sum(map(len, items)) / 3


def test_best_keeps_ties_by_id():
    best = L.Best(2, 3)
    best.add(np.array([9, 4, 7]), np.array([[5, 5, 5], [0, 0, 1]]))
    best.add(np.array([1, 8]), np.array([[5, 4], [1, 0]]))
    assert list(zip(best.item.tolist(), best.doc.tolist())) == [(0, 1), (0, 4), (0, 7), (1, 1), (1, 7)]
