"""Rows by a broadcast bitmap equal the semi join; texts are not shuffled."""

from pyspark.sql import functions as F

from paraspark.operators import bitmap as BM
from paraspark.operators import stored as ST
from paraspark.operators import table as TB
from paraspark.streaming import ingest as IN

KEYS = [0, 1, 7, 8, 32767, 32768, 65535, 10**12, -1, -32768, -32769, None, 7]
ROW = "id LONG, source_lang STRING, source_text STRING, target_lang STRING, target_text STRING"


def test_rows_in_equals_the_semi_join(spark, monkeypatch):
    rows = spark.createDataFrame([(k, str(i)) for i, k in enumerate([*KEYS, 2, 9, 32766, 10**12 + 1, -2])], "k LONG, v STRING")
    wanted = spark.createDataFrame([(k,) for k in [*KEYS, 5, 8]], "k LONG")
    want = sorted(map(tuple, rows.join(wanted, "k", "left_semi").collect()))
    got = BM.rows_in(rows, wanted, "k")
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["k", "v"]
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(BM, "BROADCAST_BITMAPS", 2)
    assert sorted(map(tuple, BM.rows_in(rows, wanted, "k").collect())) == want
    assert BM.rows_in(rows, wanted.limit(0), "k").count() == 0


def test_the_update_equals_update_by_key_and_shuffles_once(spark, tmp_path, monkeypatch):
    old = spark.createDataFrame([(i, "fr", f"s{i}", "dr", None if i % 4 else "t") for i in range(50)], ROW)
    changes = spark.createDataFrame([(3, "en", "x", "dr", "1", 1), (3, "en", "x", "dr", "2", 2), (4, None, None, None, None, 1), (4, "a", "a", "a", "a", None),
                                     (77, "en", "y", "dr", "9", 1), (None, "en", "z", "dr", "9", 1)], ROW + ", seq INT")
    path = str(tmp_path / "t")
    ST.write_ranges(old, path, width=10)
    seen, write = [], ST._write
    monkeypatch.setattr(ST, "_write", lambda rows, *a: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, *a)))
    ST.update_stored(spark, path, changes, ROW, order="seq", width=10)
    want, _ = TB.update_by_key(old, changes, order="seq")
    assert sorted(map(repr, ST.read_ranges(spark, path, ROW).collect())) == sorted(map(repr, want.collect()))
    assert seen[0].count("Exchange hashpartitioning") == 1


def test_a_batch_shuffles_no_text(spark, tmp_path, monkeypatch):
    fields = ["a", "b"]
    df = spark.createDataFrame([("x", "1"), ("x", "1"), ("y", None), (None, "z")], "a STRING, b STRING").withColumn(IN.DIGEST, IN.key_digest(fields))
    plans, write = [], IN.LD.write_load
    monkeypatch.setattr(IN.LD, "write_load", lambda rows, *a: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, *a)))
    target = str(tmp_path / "t")
    IN.absorb(df, target, "l1", fields)
    IN.absorb(df.unionByName(df.withColumn("a", F.lit("w")).withColumn(IN.DIGEST, IN.key_digest(fields))), target, "l2", fields)
    got = sorted(map(repr, IN.read_target(spark, target, df.select(*fields).schema).collect()))
    assert got == sorted(map(repr, spark.createDataFrame([("x", "1"), ("y", None), (None, "z"), ("w", "1"), ("w", None), ("w", "z")], "a STRING, b STRING").collect()))
    assert all("Exchange hashpartitioning" not in p for p in plans[0::2])
