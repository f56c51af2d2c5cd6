"""Operators with driver-side steps or numbering on empty inputs: no error,
empty (or all-null single-row) results."""

from pyspark.sql import functions as F

from paraspark.operators import corpus as CO
from paraspark.operators import encode as EN
from paraspark.operators import profile as PR
from paraspark.operators import score as SC
from paraspark.operators.pairing import greedy_pairs_long
from paraspark.operators.ranking import exact_quantiles, with_row_index


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_numbering_empty(spark):
    df = _empty(spark, "k long")
    assert with_row_index(df, ["k"], "rid").count() == 0


def test_split_quantiles_histogram_empty(spark):
    df = _empty(spark, "id long, x double")
    assert CO.split_train_test(df, "id").count() == 0
    q = exact_quantiles(df, "x", [0.25, 0.5]).first()
    assert q["q25"] is None and q["q50"] is None
    assert PR.histogram(df, "x", 5).count() == 0


def test_encode_bleu_pairing_empty(spark):
    tr = _empty(spark, "id long, a string, b string")
    assert EN.encode(tr, "id", ["a", "b"]).count() == 0
    hr = _empty(spark, "key string, hyp string, ref string")
    assert SC.corpus_bleu(hr, "hyp", "ref", "key").count() <= 1
    turns = _empty(spark, "c long, turn int, role string, content string")
    assert greedy_pairs_long(turns, ["c"]).count() == 0


def test_encode_row_without_tokens(spark):
    df = spark.createDataFrame([(1, "a b", "   "), (2, None, "b")], "id long, s string, t string")
    got = {r["id"]: (r["s_ids"][:3], r["t_ids"][:3]) for r in EN.encode(df, "id", ["s", "t"]).collect()}
    # vocabulary by (count desc, token): b=1, a=2; padding is 0
    assert got == {1: ([2, 1, 0], [0, 0, 0]), 2: ([0, 0, 0], [1, 0, 0])}
