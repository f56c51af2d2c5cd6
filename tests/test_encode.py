"""M1: the lookup under a skewed vocabulary."""

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from paraspark.functions import text as T
from paraspark.operators import encode as EN


def brute(rows, seq_len):
    tokens = Counter(t for _, a, b in rows for x in (a, b) for t in (x or "").split())
    ids = {t: i + 1 for i, (t, _) in enumerate(sorted(tokens.items(), key=lambda kv: (-kv[1], kv[0])))}
    def enc(x):
        return ([ids[t] for t in (x or "").split()][:seq_len] + [0] * seq_len)[:seq_len]
    return sorted((i, enc(a), enc(b)) for i, a, b in rows)


@pytest.mark.parametrize("heavy", [0, 2, 1 << 16])
def test_encode_equals_plain_python(spark, monkeypatch, heavy):
    monkeypatch.setattr(EN, "HEAVY", heavy)
    long = "y" * (EN.HEAVY_BYTES + 1)
    rows = [(i, "the " * (i % 5) + f"w{i % 7} x the\x1cé", f"{long} the w{i % 3}　z") for i in range(60)]
    rows += [(100, None, "a"), (101, "", None), (102, " \n ", "the the"), (103, "\x000 \x00103", "the " * 300)]
    df = spark.createDataFrame(rows, "id LONG, s STRING, t STRING")
    got = sorted((r.id, list(r.s_ids), list(r.t_ids)) for r in EN.encode(df, "id", ["s", "t"], seq_len=16).collect())
    assert got == brute(rows, 16)


def test_a_frequent_token_is_no_hot_join_key(spark):
    """Half of all tokens are one token: the tasks of the join get like
    shares of the rows."""
    rows = spark.range(4000).select("id", F.explode(F.array(*[F.struct(F.lit(0).alias("f"), F.lit(p).alias("pos"),
        (F.lit("the") if p % 2 else F.concat(F.lit("w"), (F.col("id") * 20 + p).cast("string"))).alias("token")) for p in range(20)])).alias("x")).select("id", "x.*")
    vocab = EN.vocabulary(rows.select("token"))
    assert vocab.filter("token = 'the'").first().tok_id == 1
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        plain = rows.join(vocab, "token", "left").groupBy(F.spark_partition_id().alias("p")).agg(F.count("tok_id").alias("n")).collect()
        split = EN.lookup(rows, vocab, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.count("tok_id").alias("n")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert max(r.n for r in plain) > 5 * median(r.n for r in plain)
    assert len(split) == 16 and max(r.n for r in split) < 1.5 * median(r.n for r in split)
    assert sum(r.n for r in split) == 80_000


def test_tokens_are_those_of_str_split(spark):
    import random

    from paraspark import schemas as S
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "é", "日", "​", *S.WS_CHARS]) for _ in range(r.randrange(12))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    for x in df.select("i", T.ws_tokens("t").alias("w")).collect():
        assert list(x.w) == texts[x.i].split(), texts[x.i]
