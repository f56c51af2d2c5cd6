"""All-or-nothing loads."""

import os

import pytest
from pyspark.sql import functions as F

from paraspark.sources import loads as LD

SCHEMA = "id LONG, lang STRING, text STRING"


def rows(spark, n, lang="fr"):
    return spark.range(n).select("id", F.lit(lang).cast("string").alias("lang"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))


def test_a_reader_sees_all_of_a_load_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert LD.read_loads(spark, path, SCHEMA).count() == 0
    LD.bulk_load(rows(spark, 10), path, ["lang"], "first")
    # a load that dies in its last task leaves its other tasks' output aside
    broken = rows(spark, 1000).repartition(8).withColumn("text", F.when(F.col("id") == 999, F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        LD.bulk_load(broken, path, ["lang"], "second")
    assert LD.read_loads(spark, path, SCHEMA).count() == 10
    # one that dies between its write and its publication leaves whole files, still not visible
    LD.write_load(rows(spark, 1000), path, "second", ["lang"])
    assert any(f.endswith(".parquet") for _, _, fs in os.walk(f"{path}/load=second") for f in fs)
    assert LD.read_loads(spark, path, SCHEMA).count() == 10
    # tried again it is there once, and a repeat of a published id adds nothing
    for _ in range(2):
        LD.bulk_load(rows(spark, 1000), path, ["lang"], "second")
    assert LD.read_loads(spark, path, SCHEMA).count() == 1010


def test_folders_prune_and_blank_values_survive(spark, tmp_path):
    path = str(tmp_path / "t")
    for lang in ("fr", "", "007", None):
        LD.bulk_load(rows(spark, 3, lang), path, ["lang"])
    t = LD.read_loads(spark, path, SCHEMA, ["lang"])
    assert sorted(map(repr, (r.lang for r in t.select("lang").distinct().collect()))) == sorted(map(repr, ["fr", "", "007", None]))
    one = t.filter("lang = 'fr'")
    assert "PartitionFilters: []" not in one._jdf.queryExecution().executedPlan().toString() and one.count() == 3


def test_compaction_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(5):
        LD.bulk_load(rows(spark, 4, f"l{k}"), path, ["lang"])
    before = sorted(map(tuple, LD.read_loads(spark, path, SCHEMA, ["lang"]).collect()))
    begun = LD.read_loads(spark, path, SCHEMA, ["lang"])  # a reader that began before
    assert LD.compact(spark, path, SCHEMA, ["lang"]).startswith("compact-")
    assert sorted(map(tuple, begun.collect())) == before
    LD.bulk_load(rows(spark, 1, "new"), path, ["lang"], "later")
    LD.vacuum(spark, path)
    assert sorted(os.listdir(path))[-1] == "load=later" and len([f for f in os.listdir(path) if f.startswith("load=")]) == 2
    after = sorted(map(tuple, LD.read_loads(spark, path, SCHEMA, ["lang"]).collect()))
    assert after == sorted([*before, (0, "new", "t0")])
