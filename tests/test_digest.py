"""Digest grouping: exact results, no texts in the shuffle."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paraspark.operators import corpus as CO
from paraspark.operators import digest as DG
from paraspark.operators import table as TB

SCHEMA = "id LONG, source_lang STRING, source_text STRING, target_lang STRING, target_text STRING"


def rows(n, length=1):
    r = random.Random(n)
    return [(i, r.choice(["fr", "en", None]), r.choice([None, "", "a", "b:", "1:a", "é"]) and r.choice(["a", "b:", "1:a", "é"]) * length,
             "dr", r.choice(["x", "", None, "-"])) for i in range(n)]


@pytest.mark.parametrize("row_key", [None, "id"])
def test_repeated_keys(spark, row_key):
    data = rows(400) + [(1000, "f", "r", "dr", "x"), (1001, "fr", "", "dr", "x"), (1002, None, None, None, None), (1003, None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    want = Counter(r[1:] for r in data)
    got = DG.repeated_keys(df, TB.FIELDS, row_key=row_key).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*k, n)) for k, n in want.items() if n > 1)
    full = Counter(r[1:] for r in data if None not in r[1:])
    got = TB.duplicate_keys(df, row_key=row_key).collect()
    assert {tuple(r)[:4]: r.occurrences for r in got} == {k: n for k, n in full.items() if n > 1}
    assert tuple(CO.dedupe_accounting(df).first()) == (len(data), len(want), len(data) - len(want))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert DG.repeated_keys(df, TB.FIELDS, row_key="id").count() == 0
    assert tuple(CO.dedupe_accounting(df).first()) == (0, 0, 0)


def test_field_borders_are_part_of_the_key(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "-"), ("-", None), ("1:a", ""), ("", "1:a"), ("", None), (None, "")], "x STRING, y STRING")
    assert df.select(DG.key_digest(["x", "y"])).distinct().count() == 8


def test_a_shared_digest_fails_loudly(spark, monkeypatch):
    monkeypatch.setattr(DG, "key_digest", lambda keys: F.lit(b"same"))
    df = spark.createDataFrame([("a",), ("b",)], "x STRING")
    with pytest.raises(Exception, match="share a SHA-256 digest"):
        DG.digest_groups(df, ["x"]).collect()


def shuffled(df) -> int:
    """Bytes that the finished query's shuffles hold."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += node.metrics().apply("dataSize").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def test_shuffles_do_not_grow_with_the_texts(spark):
    for run in (lambda df: CO.dedupe_accounting(df), lambda df: TB.duplicate_keys(df, row_key="id")):
        short, long = (shuffled(run(spark.createDataFrame(rows(300, n), SCHEMA).repartition(4, "id").checkpoint())) for n in (1, 5000))
        assert long == short, (short, long)
    grown = shuffled(spark.createDataFrame(rows(300, 5000), SCHEMA).select(*TB.FIELDS).distinct())
    assert grown > 100_000  # what grouping by the texts themselves moves


def test_old_texts_are_not_shuffled_by_an_insert(spark):
    old, new = (spark.createDataFrame(rows(300, n), SCHEMA).checkpoint() for n in (5000, 1))
    plan = TB.insert_if_absent(old, new, TB.FIELDS, winner="id")._jdf.queryExecution().executedPlan().toString()
    shuffles = [m for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]
    assert shuffles and all("_digest" in m for m in shuffles)
