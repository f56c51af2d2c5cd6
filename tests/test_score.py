"""Corpus BLEU (F14/F15) against a plain-Python statement of the metric, and
run-metric analytics (F16-F18)."""

import math
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from paraspark.operators import score as SC


def py_tok(line):
    line = line.rstrip()
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def py_bleu(hyps, refs):
    correct, total = [0] * 4, [0] * 4
    sys_len = ref_len = 0
    for h, r in zip(hyps, refs):
        h, r = py_tok(h), py_tok(r)
        sys_len += len(h)
        ref_len += len(r)
        for n in range(1, 5):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += max(0, len(h) - n + 1)
    precisions, mult = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            break
        if correct[n] == 0:
            mult *= 2
            precisions[n] = 100.0 / (mult * total[n])
        else:
            precisions[n] = 100.0 * correct[n] / total[n]
    bp = 1.0 if sys_len >= ref_len else (math.exp(1 - ref_len / sys_len) if sys_len > 0 else 0.0)
    return bp * math.exp(sum(math.log(p) if p > 0 else -9999999999 for p in precisions) / 4)


CASES = [
    (["the cat sat on the mat.", "hello, world!"], ["the cat sat on a mat.", "hello world!"]),
    (["a b c d e f"], ["a b c d e f"]),
    (["completely different"], ["nothing in common here at all"]),
    (["1,000 items - 3-4 days"], ["1,000 items in 3-4 days"]),
    (["short"], ["a much longer reference sentence"]),
]


@pytest.mark.parametrize("hyps,refs", CASES)
def test_bleu_matches_python(spark, hyps, refs):
    df = spark.createDataFrame([(str(i), h, r) for i, (h, r) in enumerate(zip(hyps, refs))], "k string, h string, r string")
    got = SC.corpus_bleu(df, "h", "r", "k").first()["bleu"]
    assert got == pytest.approx(py_bleu(hyps, refs), rel=1e-9, abs=1e-9)


def test_compare_systems(spark):
    df = spark.createDataFrame([("1", "the cat sat", "a cat", "the cat sat")], "k string, a string, b string, ref string")
    st = SC.stack_systems(df, "k", "ref", {"A": "a", "B": "b"})
    got = {r["system"]: r["bleu"] for r in SC.corpus_bleu(st, "hyp", "ref", "k", ["system"]).collect()}
    assert got["A"] == pytest.approx(py_bleu(["the cat sat"], ["the cat sat"]))
    assert got["B"] == pytest.approx(py_bleu(["a cat"], ["the cat sat"]))


def test_wide_systems_match_python(spark):
    import random
    rnd = random.Random(5)
    words = ["the", "cat", "sat", "on", "a", "mat", ".", ",", "dog", "1-2"]
    refs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(40)]
    sys_a = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(40)]
    sys_b = [r if i % 3 else "" for i, r in enumerate(refs)]
    df = spark.createDataFrame([(str(i), a, b, r) for i, (a, b, r) in enumerate(zip(sys_a, sys_b, refs))],
                               "k string, a string, b string, ref string")
    got = {r["system"]: r for r in SC.corpus_bleu_systems(df, "k", "ref", {"A": "a", "B": "b"}).collect()}
    assert got["A"]["bleu"] == pytest.approx(py_bleu(sys_a, refs), rel=1e-9, abs=1e-9)
    assert got["B"]["bleu"] == pytest.approx(py_bleu(sys_b, refs), rel=1e-9, abs=1e-9)
    stacked = SC.stack_systems(df, "k", "ref", {"A": "a", "B": "b"})
    long = {r["system"]: r for r in SC.corpus_bleu(stacked, "hyp", "ref", "k", ["system"]).collect()}
    for name in ("A", "B"):
        assert (got[name]["sys_len"], got[name]["ref_len"]) == (long[name]["sys_len"], long[name]["ref_len"])


def test_best_kept_latest(spark):
    rows = [("r", "bleu", s, v) for s, v in [(1, 5.0), (2, 9.0), (3, 9.0), (4, 1.0), (5, 2.0), (6, 3.0)]]
    df = spark.createDataFrame(rows, "run_id string, metric string, step long, value double")
    best = SC.best_step(df, ["run_id", "metric"]).first()
    assert (best["best_step"], best["best_value"]) == (2, 9.0)  # ties -> earliest step
    kept = sorted(r["step"] for r in SC.kept_checkpoints(df, ["run_id", "metric"], 3).collect())
    assert kept == [2, 5, 6]
    last = SC.latest_value(df, ["run_id", "metric"]).first()
    assert (last["last_step"], last["last_value"]) == (6, 3.0)


def test_no_match_scores_zero(spark):
    df = spark.createDataFrame([("k1", "a b c d e f", "u v w x y z")], "key string, hyp string, ref string")
    assert SC.corpus_bleu(df, "hyp", "ref", "key").first()["bleu"] == 0.0
    wide = df.withColumn("hyp_b", F.col("ref"))
    got = {r["system"]: r["bleu"] for r in SC.corpus_bleu_systems(wide, "key", "ref", {"A": "hyp", "B": "hyp_b"}).collect()}
    assert got["A"] == 0.0 and abs(got["B"] - 100.0) < 1e-9


def test_kept_checkpoints_best_inside_and_outside(spark):
    rows = [("in", s, float(s)) for s in range(10)] + [("out", s, float(-s)) for s in range(10)] + [("few", 1, 0.5)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    got = {}
    for r in SC.kept_checkpoints(df, ["run"], 3).collect():
        got.setdefault(r["run"], set()).add((r["step"], r["is_best"]))
    assert got == {"in": {(9, True), (8, False), (7, False)}, "out": {(0, True), (9, False), (8, False)}, "few": {(1, True)}}
