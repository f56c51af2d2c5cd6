import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paraspark.llm import near_dedup as N
from paraspark.llm.components import connected_components
from tests.llm.helpers import docs


def brute(rows, percent=85):
    """Components by comparing every two full shingle sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set()).update({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else ())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(seed, n, words=120, edits=3):
    r = random.Random(seed)
    base = [f"w{r.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"e{r.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def check(spark, rows):
    got = N.near_components(docs(spark, rows, extra=True)).collect()
    want = brute([r for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_edge_cases(spark):
    long = family(1, 1, words=20_000)[0]
    rows = [(9, "A b c"), (4, "a B  c"), (8, "a b c d"), (3, None), (2, ""), (1, " \t"), (20, long), (21, long + " tail"), (30, "É a b c d e"),
            (31, "é a b c d e"), (40, "same text of six words here"), (40, "same text of six words here"), (None, "a b c")]
    check(spark, rows)


def test_near_copies_against_brute_force(spark):
    texts = family(2, 25, edits=4) + family(3, 3) + family(4, 2, words=6, edits=0) + [f"lonely {i} text of its own number {i * 7}" for i in range(20)]
    check(spark, [(100 - i, t) for i, t in enumerate(texts)])


def test_families_beyond_one_chunk(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK_DOCS", 7)
    check(spark, list(enumerate(family(5, 60, words=60, edits=5))))


def test_empty_table_and_stage(spark):
    assert N.near_components(docs(spark, [])).count() == 0
    d = docs(spark, [(1, "one two three four five six"), (2, "one  two three four five six"), (3, "other"), (None, "other")], extra=True)
    out = N.keep_representatives(d)
    assert out.columns == d.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=2, max_size=12))
def test_link_group_joins_what_all_pairs_would(sets):
    arrays = [np.unique(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    ids = np.arange(len(sets))

    def comps(links):
        root = list(ids)
        for a, b in links:
            x, y = root[a], root[b]
            root = [x if z == y else z for z in root]
        return [root.index(z) for z in root]
    every = [(i, j) for i in ids for j in ids[:i] if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert comps(N.link_group(ids, arrays, ids.copy())) == comps(every)


def test_connected_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(edges + [(None, 3), (7, None)], "a LONG, b LONG")
    got = {x.node: x.component for x in connected_components(df, "a", "b").collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_components_without_broadcast(spark, monkeypatch):
    from paraspark.llm import components
    monkeypatch.setattr(components, "BROADCAST_ROWS", -1)
    df = spark.createDataFrame([(i, i + 1) for i in range(10)], "a LONG, b LONG")
    assert {x.component for x in connected_components(df, "a", "b").collect()} == {0}


def test_link_rule_is_a_parameter(spark):
    """Similarity 86/106 = 0.81: linked at 0.80, not at 0.85."""
    words = [f"w{i}" for i in range(100)]
    d = docs(spark, [(1, " ".join(words)), (2, " ".join(words[:90] + [f"e{i}" for i in range(10)])), (3, "other words")])
    assert sorted(r.doc_id for r in N.keep_representatives(d).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in N.keep_representatives(d, rule=N.LINK_80).collect()) == [1, 3]


def test_bands_of_the_rules_miss_next_to_nothing():
    for rule in (N.LINK_85, N.LINK_80):
        p = rule.percent / 100
        assert (1 - p ** rule.rows) ** rule.bands < 2e-6
        assert rule.margin > 5 * (p * (1 - p) / (rule.bands * rule.rows)) ** 0.5


def test_tasks_forget_their_words(spark, monkeypatch):
    """A worker lives on after a task: the words it has hashed must not."""
    tasks = []
    monkeypatch.setattr(N, "map_arrow", lambda df, fn, schema: tasks.append((df, fn)))
    N.profiles(docs(spark, [(1, "a b c d e f"), (2, None)]), "doc_id", "text")
    members = docs(spark, [(1, "a b c d e f")]).selectExpr("doc_id", "text", "0L AS k1", "0L AS k2", "0L AS family", "1L AS chunks")
    N.shingle_sets(members, "doc_id", "text")
    for df, fn in tasks:
        held = [len(N._words) for b in fn(iter(df.toArrow().to_batches())) if b.num_columns]
        assert max(held) and not N._words
    assert len(tasks) == 2
