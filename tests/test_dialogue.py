"""Turn-per-row chat operators against the array functions and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from paraspark.functions import chat as C
from paraspark.functions import text as T
from paraspark.operators import dialogue as D
from paraspark.operators import pairing as P
from paraspark.plans import pipelines as PL

CONTENTS = ["a", "b c", "", " ", "ترجم x: d", "e\nf", "g\\xa0h", None, "a<|assistant|>b", "a<|assistant|>b<|user|>c", "<|user|>c<|assistant|> ", "x<|user|>y<|assistant|>z"]


def conversations(seed, n, longest):
    r = random.Random(seed)
    return [[(r.choice(CONTENTS), r.choice(["user", "user", "assistant", "assistant", "system", None])) for _ in range(r.randint(1, longest))] for _ in range(n)]


def frames(spark, convs):
    turns = spark.createDataFrame([(i, 3 * t, role, text) for i, c in enumerate(convs) for t, (text, role) in enumerate(c)],
                                  "id LONG, turn LONG, role STRING, content STRING")
    arrays = turns.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "content", "role"))).alias("m")).select(
        "id", F.transform("m", lambda x: F.struct(x["content"].alias("content"), x["role"].alias("role"))).alias("messages"))
    return turns, arrays


@pytest.mark.parametrize("block", [1, 4, 7, 1024])
def test_dispatch_equals_the_array_form(spark, block):
    turns, arrays = frames(spark, conversations(block, 120, 14) + [[("u<|assistant|>", "user"), ("last", "assistant")], [("only", "user")]])
    arrays = arrays.withColumn("fb", F.get("messages", 0)["content"])
    for fallback in (None, "fb"):
        want = C.add_pairs(arrays, fallback=fallback).select("id", F.posexplode("pairs").alias("pos", "p"))
        want = sorted(map(repr, want.select("id", "pos", "p.texte_cible", "p.traduction").collect()))
        got = D.dispatch_long(turns, ["id"], fallback=D.opening_content() if fallback else None, block=block)
        rows = got.collect()
        assert sorted(repr(r) for r in got.select("id", "pos", "texte_cible", "traduction").collect()) == want
        sizes = {}
        for r in rows:
            sizes[r.id] = sizes.get(r.id, 0) + 1
        assert all(r.n_pairs == sizes[r.id] for r in rows)
    counts = {r.id: (r.n_pairs, r.problem) for r in D.pair_counts_long(turns, ["id"], block=block).collect()}
    marked = {r.id for r in rows if r.marked}
    for r in C.add_pairs(arrays).select("id", F.size("pairs").alias("n"), C.is_marked_first("messages").alias("mk")).collect():
        assert counts[r.id] == (r.n, r.n == 0)
        assert r.mk == (r.id in marked) or r.n == 0
    assert marked and len(marked) < len(counts)


def test_metrics_equal_the_array_form(spark):
    turns, arrays = frames(spark, conversations(5, 80, 9) + [[("جملة مسبوقة: x" + "y" * 50, "user")]])
    want = arrays.select("id", C.message_count("messages").alias("n_messages"), F.length(C.messages_json("messages")).cast("long").alias("json_len"),
                         C.first_message_length("messages").alias("first_len"))
    assert sorted(map(tuple, D.message_metrics(turns, ["id"]).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    want = arrays.select("id", C.message_count_json(C.messages_json("messages")).alias("n"))
    assert sorted(map(tuple, D.json_message_counts(turns, ["id"], block=4).collect())) == sorted(map(tuple, want.collect()))
    want = arrays.filter(C.is_marked_first("messages")).select("id", F.get("messages", 0)["content"])
    assert sorted(map(tuple, D.marked_openings(turns, ["id"]).collect())) == sorted(map(tuple, want.collect()))


def test_flat_pairs_equal_the_array_form(spark):
    turns, arrays = frames(spark, conversations(6, 60, 9))
    def add(x):
        return x.withColumns({"direction": F.get(F.array(*map(F.lit, ["en_dr", "fr_dr", "ar_dr", "dr_en"])), (F.col("id") % 5).cast("int")), "dataset": F.lit("d")})
    want = PL.flatten_pairs(PL.chat_to_pairs(add(arrays), T.NATIVE))
    got = PL.flat_pairs_long(add(turns))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.withColumn("pos", F.col("pos").cast("long")).collect()))


def test_empty_table(spark):
    turns, _ = frames(spark, [[("a", "user")]])
    none = turns.filter("id < 0")
    for out in (D.dispatch_long(none, ["id"]), D.pair_counts_long(none, ["id"]), D.message_metrics(none, ["id"]), D.marked_openings(none, ["id"])):
        assert out.count() == 0


def test_a_hot_conversation_is_many_tasks(spark):
    """One conversation with a third of all turns: its turns lie in many
    partitions of both window stages, and no array of messages is built."""
    n = 60_000
    turns = spark.range(3 * n).select(F.when(F.col("id") < n, -1).otherwise(F.floor(F.col("id") / 6)).alias("id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.lit("m"), F.col("id").cast("string")).alias("content"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = P.turn_rows(turns, ["id"], "turn", "role", "content", P.BLOCK)
        placed = rows.select("_key.id", "_brk", F.spark_partition_id().alias("p"))  # reads a window column, so the windows stay
        parts = placed.filter("id = -1 AND _brk >= 0").groupBy("p").agg(F.count(F.lit(1)).alias("count"), F.max("_brk")).collect()
        assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in parts) < n / 3
        out = D.dispatch_long(turns, ["id"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "SinglePartition" not in plan
        assert plan.count("Exchange hashpartitioning") <= 4  # the turns once (read by both sides), their blocks twice
        hot = out.filter("id = -1").agg(F.count("*"), F.max("pos"), F.max("n_pairs"), F.sum((F.col("traduction") != "").cast("int"))).first()
        assert tuple(hot) == (n // 2, n // 2 - 1, n // 2, n // 2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_marked_input_keeps_every_spoken_turn(spark, tmp_path):
    """The head of a long even conversation is one marked message of bounded
    size, its later turns stay rows."""
    from paraspark.plans import adapters as A
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{c}-{t}") for c in (1, 2) for t in range(150)] + [(4, 0, "system", "s")]
    spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {}
    for r in A.marked_turns(spark, str(tmp_path)).orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.content))
    assert len(got[1]) == 150 and got[4] == [("system", "s")]
    said = "".join(c for _, c in got[2])
    assert all(f"t2-{t}" in said for t in range(150))
    assert got[2][0][1].count("<|") <= A.MARK_TURNS and len(got[2]) >= 150 - A.MARK_TURNS


@pytest.mark.parametrize("key", ["d7_markers", "e2_split_marked", "e4_dispatch", "e5_fill_last", "e6_unmatched"])
def test_long_conversations_match_the_oracle(spark, tmp_path, key):
    import duckdb

    from paraspark.plans import registry
    registry.load_all()
    r = random.Random(8)
    said = ["a the b", "x", "", "q<|user|>w", "z<|assistant|>y"]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(said)) for c in range(24) for t in range(r.choice([1, 3, 63, 64, 65, 150]))]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel = con.sql(registry.ORACLE[key])
    got = registry.QUERIES[key](spark, str(tmp_path)).select(*rel.columns).collect()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))
