"""Distributed numbering (H3), quantiles (F9), split/sample (H4-H6)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraspark.operators import corpus as CO
from paraspark.operators.ranking import exact_quantiles, with_row_index


def test_row_index_dense_and_ordered(spark):
    random.seed(1)
    rows = [(random.randint(0, 50), f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    out = with_row_index(df, ["a", "b"], "rid", num_partitions=7).collect()
    got = sorted((r["rid"], r["a"], r["b"]) for r in out)
    assert [g[0] for g in got] == list(range(1, 3001))
    assert [(g[1], g[2]) for g in got] == sorted(rows)


def test_row_index_descending_key(spark):
    df = spark.createDataFrame([(i % 5, str(i)) for i in range(200)], "f int, t string")
    out = with_row_index(df, [("f", False), "t"], "rid", num_partitions=4).orderBy("rid").collect()
    assert [(r["f"], r["t"]) for r in out] == sorted([(i % 5, str(i)) for i in range(200)], key=lambda x: (-x[0], x[1]))


def test_row_index_many_buckets_and_start(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    out = with_row_index(df, ["k"], "rid", start=0, num_partitions=300).collect()
    assert sorted((r["rid"], r["k"]) for r in out) == [(i, i) for i in range(5000)]


def test_exact_quantiles(spark):
    random.seed(2)
    vals = [random.random() * 100 for _ in range(1001)] + [5.0] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, "x", [0.25, 0.5, 0.75], num_partitions=5).first()
    assert np.allclose([q["q25"], q["q50"], q["q75"]], np.quantile(vals, [0.25, 0.5, 0.75]))


def test_split_is_exact_and_deterministic(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", "k")
    a = CO.split_train_test(df, "k")
    b = CO.split_train_test(df, "k")
    test_a = {r["k"] for r in a.filter(F.col("split") == "test").collect()}
    test_b = {r["k"] for r in b.filter(F.col("split") == "test").collect()}
    assert len(test_a) == 100 and test_a == test_b
    sample = [r["k"] for r in CO.seeded_sample(df, "k", 10).collect()]
    assert len(sample) == 10 and len(set(sample)) == 10


def test_quantiles_with_a_hot_value(spark):
    random.seed(3)
    vals = [random.randint(0, 1000) / 7 for _ in range(2000)] + [42.0] * 1000  # a third is one value
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, "x", [0.1, 0.25, 0.5, 0.75, 0.9], num_partitions=6).first()
    assert np.allclose([q["q10"], q["q25"], q["q50"], q["q75"], q["q90"]],
                       np.quantile(vals, [0.1, 0.25, 0.5, 0.75, 0.9]))


def test_running_total(spark):
    from paraspark.operators.ranking import with_running_total
    rows = [(i, (i * 7) % 5 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, w int")
    got = {r["k"]: r["rt"] for r in with_running_total(df, ["k"], "w", "rt", num_partitions=5).collect()}
    acc = 0
    for k, w in rows:
        acc += w
        assert got[k] == acc


@pytest.mark.parametrize("ranked", [1, 5, 100_000])
def test_split_in_digit_steps(spark, monkeypatch, ranked):
    """The boundary is the same however often the rows are counted by digits."""
    import hashlib

    from paraspark.operators import corpus as CO
    monkeypatch.setattr(CO, "RANKED", ranked)
    got = {r["id"] for r in CO.split_train_test(spark.range(300), "id", 0.1, 42).filter("split = 'test'").collect()}
    assert got == set(sorted(range(300), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:30])


def test_approximate_quantiles_keep_their_rank_error(spark):
    from paraspark.operators.ranking import approx_quantiles
    r = random.Random(5)
    values = sorted(r.choice([r.randrange(50), r.randrange(10**6)]) for _ in range(40_000))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v LONG").repartition(7)
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    for error in (0.05, 0.002):
        for p, q in zip(probs, approx_quantiles(df, "v", probs, error).first()):
            low, high = np.searchsorted(values, q, "left"), np.searchsorted(values, q, "right")
            assert low / len(values) - error <= p <= high / len(values) + error
    assert list(approx_quantiles(df.limit(0), "v", probs).first()) == [None] * 5
