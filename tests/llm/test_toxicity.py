import random
import zlib

import numpy as np

from paraspark.llm import toxicity as X
from tests.llm.helpers import docs


def corpus(n=600, seed=1):
    """Every fifth text holds one of a few made-up bad stems (never in the
    fixed list); labels for most, a few of them wrong."""
    r = random.Random(seed)
    rows, labels, truth = [], [], {}
    for i in range(n):
        w = [f"{r.choice('bdfgk')}o{r.choice('lmnr')}{r.choice('aeiu')}{r.randrange(40)}x".translate(str.maketrans("0123456789", "qwertyuiop"))
             for _ in range(r.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["zakru", "vimpel", "hutzok"]) + r.choice(["", "an", "ek"]))
        rows.append((i, " ".join(w), r.choice(["en", "fr"]), "src1"))
        truth[i] = int(bad)
        if i % 4:
            labels.append((i, 1, int(bad)))
    return rows, labels, truth


def lab(spark, rows):
    return spark.createDataFrame(rows, "doc_id LONG, quality INT, toxic INT")


def test_held_out_accuracy_and_columns(spark):
    rows, labels, truth = corpus()
    got = X.score_documents(docs(spark, rows, extra=True), lab(spark, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97


def test_held_out_labels_are_not_read(spark):
    rows, labels, _ = corpus()
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a = {r.doc_id: r.score for r in X.score_documents(docs(spark, rows), lab(spark, labels)).collect()}
    b = {r.doc_id: r.score for r in X.score_documents(docs(spark, rows), lab(spark, flipped)).collect()}
    assert a == b


def test_edge_cases(spark):
    rows, labels, _ = corpus(200)
    more = [(1000, None), (1001, ""), (1002, "\t\n"), (None, "zakru zakru"), (3, rows[3][1]), (1003, "word " * 50_000 + "vimpel"), (1004, "12 !? 34")]
    labels += [(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 0)]
    got = X.score_documents(docs(spark, [(r[0], r[1]) for r in rows] + more), lab(spark, labels)).collect()
    assert len(got) == len(rows) + len(more)
    score = {r.doc_id: r for r in got}
    assert score[1000].score == score[1001].score == score[1002].score and score[1000].predicted == 0
    assert score[None].predicted == 1 and score[None].held_out is False
    assert score[1003].predicted == 1


def test_without_labels_the_fixed_list_votes(spark):
    rows = [(1, "you idiot"), (2, "a fine day"), (3, None)]
    for labels in ([], [(1, 1, 1)], [(2, 1, 0)]):
        got = {r.doc_id: r.predicted for r in X.score_documents(docs(spark, rows), lab(spark, labels)).collect()}
        assert got == {1: 1, 2: 0, 3: 0}


def test_empty_table_and_stage(spark):
    rows, labels, truth = corpus(300)
    assert X.score_documents(docs(spark, []), lab(spark, labels)).count() == 0
    d = docs(spark, rows + [(None, "clean text")], extra=True)
    out = X.drop_toxic(d, lab(spark, labels))
    assert out.columns == d.columns
    kept = {r.doc_id for r in out.collect()}
    assert None in kept and np.mean([(i not in kept) == bool(t) for i, t in truth.items()]) > 0.97


def modelled(spark, votes, given):
    """The label model over counted patterns, and each row's posterior."""
    rows = [([int(g) for g in np.flatnonzero(v)], int(k)) for v, k in zip(votes, given)]
    df = spark.createDataFrame(rows, "groups ARRAY<INT>, y INT").groupBy("groups", "y").count().withColumnRenamed("count", "n")
    model = X.label_model(df.checkpoint(), votes.shape[1])
    known = {}
    return model, np.array([known.setdefault((tuple(g), k), X._posterior(model, g, k)) for g, k in rows])


def test_label_model_recovers_accuracies(spark):
    """Votes drawn from known rates: the estimate comes close, and labels that
    were turned over are mostly put right."""
    rng = np.random.default_rng(2)
    n, fire = 20_000, np.array([0.7, 0.6, 0.5, 0.4])
    y = rng.random(n) < 0.2
    votes = np.where(y[:, None], rng.random((n, 4)) < fire, rng.random((n, 4)) < 0.01)
    given = np.where(rng.random(n) < 0.3, np.where(rng.random(n) < 0.02, ~y, y).astype(int), -1)
    model, post = modelled(spark, votes, given)
    assert abs(model["share"] - 0.2) < 0.05 and np.abs(np.array(model["fires_toxic"][:4]) - fire).max() < 0.12
    assert ((post > 0.5) == y).mean() > 0.95


def test_forty_uncorrelated_voters_keep_forty_accuracies(spark):
    rng = np.random.default_rng(4)
    n, fire = 20_000, np.linspace(0.05, 0.4, 40)
    y = rng.random(n) < 0.3
    votes = np.where(y[:, None], rng.random((n, 40)) < fire, rng.random((n, 40)) < 0.005)
    assert X.group_voters([list(np.flatnonzero(v)) for v in votes[:4000]], y[:4000].astype(int), 40).tolist() == list(range(40))
    given = np.where(rng.random(n) < 0.2, y.astype(int), -1)
    model, post = modelled(spark, votes, given)
    # every voter has its own rate, in the right proportion to the others'
    got = np.array(model["fires_toxic"][:40])
    assert np.abs(got / got.mean() / (fire / fire.mean()) - 1).max() < 0.25 and np.corrcoef(got, fire)[0, 1] > 0.98
    assert len(model["fires_toxic"]) == 41  # and silence
    assert ((post > 0.5) == y).mean() > 0.85


def test_repeated_ids_do_not_grow_the_sample(spark):
    rows, labels, truth = corpus(200)
    many = [(r[0], r[1] + f" extra{k}") for r in rows[:3] for k in range(400)]
    d = docs(spark, [(r[0], r[1]) for r in rows] + many).selectExpr("doc_id AS d_id", "text AS d_text")
    sample = X.training_sample(d, X.training_labels(lab(spark, labels)))
    ids = {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5}
    assert sample.count() == len(ids)


def test_correlated_voters_share_a_group():
    rng = np.random.default_rng(3)
    a, b = rng.random(500) < 0.5, rng.random(500) < 0.5
    votes = [[i for i, v in enumerate((x, x, z)) if v] for x, z in zip(a, b)]
    assert X.group_voters(votes, np.ones(500), 3).tolist() == [0, 0, 1]


def test_linear_fit_separates():
    votes, target = [[0], [0, 1], [1], [], [2]] * 20, np.array([1, 1, 0, 0, 1.0] * 20)
    w, b = X.fit_linear(votes, target, 3)
    z = [b + sum(w[i] for i in v) for v in votes]
    assert all((x > 0) == (t > 0.5) for x, t in zip(z, target))


def test_stage_decides_row_by_row(spark):
    """NULL ids and shared ids: the toxic row goes, the clean one stays."""
    rows, labels, _ = corpus(300)
    more = [(None, "zakru vimpel zakru"), (None, "clean text"), (None, None), (9000, "hutzok vimpel"), (9000, "another clean text"), (9001, "hutzok vimpel")]
    d = docs(spark, [(r[0], r[1]) for r in rows] + more, extra=True)
    out = X.drop_toxic(d, lab(spark, labels))
    kept = sorted(str((r.doc_id, r.text)) for r in out.collect() if r.doc_id is None or r.doc_id >= 9000)
    assert out.columns == d.columns
    assert kept == sorted(map(str, [(None, "clean text"), (None, None), (9000, "another clean text")]))
