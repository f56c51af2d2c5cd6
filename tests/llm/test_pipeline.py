"""The pipeline replayed in plain Python, stage by stage."""

import re

import corpus_pipeline as P
from paraspark.llm import mixing, toxicity
from tests.llm.helpers import docs, parquet_rows
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_packing_tokens import check_pieces


def test_stages(spark, sf_small, tmp_path):
    source = parquet_rows(spark, sf_small, "documents")
    d, columns, ids = source, source.columns, []
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in d.collect()}
        out = stage(spark, d, sf_small)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name == "toxicity":
            scored = toxicity.score_documents(d, parquet_rows(spark, sf_small, "labels")).collect()
            want = {r.doc_id for r in scored if not r.predicted}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text), i)
            want = set(first.values())
        elif name == "near_dedup":
            want = {i for i, (_, c) in near_brute([(i, r.text) for i, r in before.items()], percent=80).items() if i == c}
        elif name == "mixing":
            copies = {r.id: r.copies for r in mixing.mix(d).collect() if r.copies}
            assert sorted(r.doc_id for r in rows) == sorted(i for i, n in copies.items() for _ in range(n))
            want = set(copies)
        else:
            check_pieces(rows, [(r.doc_id, r.text) for r in d.collect()])
            want = set(before)
        assert {r.doc_id for r in rows} == want and want
        if name != "packing":
            assert out.columns == columns
            assert all(tuple(r) == tuple(before[r.doc_id]) for r in rows)
        ids.append(len(rows))
        d = out
    assert ids[0] < source.count() and ids[1] < ids[0] and ids[2] <= ids[1]


def test_run_equals_the_stages(spark, sf_small):
    rows = P.run(spark, sf_small).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_on_hard_rows(spark, sf_small):
    """NULLs, empties, repeats and more columns pass every stage."""
    hard = [(None, "some text with enough words"), (1, None), (2, ""), (3, " \n"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "a b c d e f g"),
            (6, "x" * 50_000), (7, "you idiot moron")]
    d = docs(spark, hard, extra=True)
    for name, stage in P.STAGES:
        out = stage(spark, d, sf_small)
        assert stage(spark, d.limit(0), sf_small).count() == 0
        if name != "packing":
            assert out.columns == d.columns
        assert out.count() > 0


def test_near_copies_from_080_on_go(spark, sf_small):
    """Similarity 86/106 = 0.81 goes, 83/109 = 0.76 stays."""
    words = [f"w{i}" for i in range(100)]
    d = docs(spark, [(1, " ".join(words)), (2, " ".join(words[:90] + [f"e{i}" for i in range(10)])),
                     (3, " ".join([f"g{i}" for i in range(13)] + words[13:]))])
    assert sorted(r.doc_id for r in dict(P.STAGES)["near_dedup"](spark, d, sf_small).collect()) == [1, 3]


def test_near_stage_against_brute_force_at_080(spark, sf_small):
    d = parquet_rows(spark, sf_small, "documents")
    sets = {}
    for r in d.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if c == y else c for i, c in root.items()}
    got = {r.doc_id for r in dict(P.STAGES)["near_dedup"](spark, d, sf_small).collect()}
    assert got == {i for i, c in root.items() if i == c}
