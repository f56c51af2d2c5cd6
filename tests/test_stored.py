"""Change sets in place: same rows as the functional ones, untouched files stay."""

import os

import pytest
from pyspark.sql import functions as F

from paraspark.operators import stored as ST
from paraspark.operators import table as TB

SCHEMA = "id LONG, source_lang STRING, source_text STRING, target_lang STRING, target_text STRING"


@pytest.fixture
def stored(spark, tmp_path):
    rows = spark.range(-20, 480).select("id", F.lit("fr").alias("source_lang"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("source_text"),
                                        F.lit("dr").alias("target_lang"), F.lit("x").alias("target_text"))
    path = str(tmp_path / "t")
    ST.write_ranges(rows, path, width=50)
    return rows, path


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def canon(df):
    return sorted(map(repr, map(tuple, df.collect())))


def folder(f):
    return int(os.path.dirname(f).rsplit("=", 1)[1])


def test_update_touches_only_its_folders(spark, stored):
    rows, path = stored
    changes = spark.createDataFrame([(3, "en", "new", "dr", "y", 1), (3, "en", "newer", "dr", "y", 2), (-7, "en", None, "dr", "z", 1), (210, "en", "n", "dr", "y", 1),
                                     (9999, "en", "unknown", "dr", "y", 1), (None, "en", "null", "dr", "y", 1)], SCHEMA + ", seq INT")
    want = canon(TB.update_by_key(rows, changes, order="seq")[0])
    before = files(path)
    ST.update_stored(spark, path, changes, SCHEMA, order="seq", width=50)
    after = files(path)
    assert canon(ST.read_ranges(spark, path, SCHEMA)) == want
    assert {f for f in before if folder(f) not in (0, -1, 4)} == set(before) & set(after)
    assert all(before[f] == after[f] for f in set(before) & set(after))
    assert ST.read_ranges(spark, path, SCHEMA, [0]).count() == 50


def test_delete_touches_only_its_folders(spark, stored):
    rows, path = stored
    keys = spark.range(95, 155).unionByName(spark.range(470, 471)).unionByName(spark.range(9000, 9001))
    before = files(path)
    ST.delete_stored(spark, path, keys, SCHEMA, width=50)
    after = files(path)
    assert canon(ST.read_ranges(spark, path, SCHEMA)) == canon(TB.delete_by_key(rows, keys)[0])
    assert {folder(f) for f in set(before) - set(after)} == {1, 2, 3, 9}
    assert 2 not in {folder(f) for f in after}  # 100 to 149 all went
    assert all(before[f] == after[f] for f in set(before) & set(after))


def test_empty_change_sets_and_appends(spark, stored):
    rows, path = stored
    before = files(path)
    ST.update_stored(spark, path, rows.limit(0), SCHEMA, width=50)
    ST.delete_stored(spark, path, rows.limit(0), SCHEMA, width=50)
    assert files(path) == before
    ST.append_stored(rows.filter("id < 5").withColumn("id", F.col("id") + 1000), path, width=50)
    after = files(path)
    assert set(before) < set(after) and all(after[f] == t for f, t in before.items())
    assert ST.read_ranges(spark, path, SCHEMA).count() == 525


def scanned(df):
    """Rows and files that the finished query's scan read."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            return tuple(node.metrics().apply(m).value() for m in ("numOutputRows", "numFiles"))
        children = node.children()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("StageExec") else \
            [children.apply(i) for i in range(children.size())]


def test_lookup_skips_folders_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    ST.write_ranges(rows, path, width=30_000, bloom=["text"], row_group_bytes=200_000)
    one = ST.lookup(spark, path, "id LONG, text STRING", 41_234, width=30_000)
    n, n_files = scanned(one)
    assert [r.id for r in one.collect()] == [41_234] and n_files == 1 and 0 < n < 10_000
    # the text is in no order: its Bloom filters skip the row groups without it
    text = rows.filter("id = 12345").first().text
    by_text = ST.read_ranges(spark, path, "id LONG, text STRING").filter(F.col("text") == text)
    n, _ = scanned(by_text)
    assert [r.id for r in by_text.collect()] == [12_345] and 0 < n < 20_000
    assert ST.lookup(spark, path, "id LONG, text STRING", 10**9, width=30_000).count() == 0
