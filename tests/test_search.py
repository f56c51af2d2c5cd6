"""Indexed text search equals the scan."""

import random

import pytest

from paraspark.operators import search as SE
from paraspark.operators import table as TB

SCHEMA = "id LONG, source_lang STRING, source_text STRING, target_lang STRING, target_text STRING"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(2)
    word = ["salam", "Été", "ÇA", "日本語", "مرحبا", "ab", "a%b_c", "ſtraße", "STRASSE", " ", "x" * 50]
    rows = [(i, r.choice(["fr", "en"]), r.choice([None, "", " ".join(r.choices(word, k=r.randrange(8)))]), "dr", "".join(r.choices(word, k=r.randrange(6))))
            for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("index") / "i")
    SE.write_index(df, path)
    return df, SE.read_index(spark, path)


@pytest.mark.parametrize("needle", ["a", "é", "AB", "lam", "ÉTÉ", "本語", "日本語", "حبا", "%b_", "ssE", "straße", "x" * 40, "m É", "no such text", "xxx", "çaab"])
def test_equals_the_scan(tables, needle):
    df, index = tables
    want = sorted(map(repr, TB.text_search(df, needle, "fr").collect()))
    assert sorted(map(repr, SE.text_search_indexed(df, index, needle, "fr").collect())) == want


def test_a_search_reads_only_its_folders(tables):
    _, index = tables
    plan = SE.candidates(index, "salam")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1][:60]
    assert "In(gram" in plan.split("PushedFilters")[1][:200]


def test_an_index_row_holds_the_keys_of_a_slice(spark, tmp_path, monkeypatch):
    """Neither a row per trigram and key, nor lists that grow with the table."""
    rows = [(i, "en", "salam \U0001F600" if i % 2 else "日本語 salam", "dr", None) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    SE.write_index(df, str(tmp_path / "whole"))
    got = {r.gram: sorted(r["keys"]) for r in SE.read_index(spark, str(tmp_path / "whole")).collect()}
    assert SE.read_index(spark, str(tmp_path / "whole")).count() == len(got) == 9
    assert got["ala"] == list(range(200)) and got["m \U0001F600"] == list(range(1, 200, 2)) and got["本語 "] == list(range(0, 200, 2))
    monkeypatch.setattr(SE, "SLICE", 100)
    SE.write_index(df, str(tmp_path / "sliced"))
    sliced = SE.read_index(spark, str(tmp_path / "sliced"))
    assert max(len(r["keys"]) for r in sliced.collect()) <= 100 // 7
    assert sorted(r.id for r in SE.candidates(sliced, "m \U0001F600").collect()) == list(range(1, 200, 2))
