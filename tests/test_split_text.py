"""Split reading of multi-line CSV and JSON against Spark's own whole-file readers."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.operators import corpus as CO
from paraspark.sources import readers as R
from paraspark.sources import split_text as ST

SCHEMA = "id INT, `the text` STRING, other STRING"
PIECES = ["a", "b c", "\n", "\r\n", '"', '""', ",", "é", "日本", "\\", " ", "{", "}", "[", "]", ":", "\t", "<|user|>"]


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "700b")
    yield
    for k, v in was.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def text(r, longest=12):
    return "".join(r.choice(PIECES) for _ in range(r.randrange(longest)))


def canon(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_equals_the_whole_file_read(spark, small_splits, tmp_path, end):
    r = random.Random(len(end))
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="") as out:
            w = csv.writer(out, lineterminator=end)
            w.writerow(["id", "the\n\"text\"", "other"])
            for i in range(300):
                w.writerow([i, text(r) if i != 150 else "x\n" * 1500, text(r)])
            if f == 0 and end == "\n":
                out.write(end)  # a blank line at the end
    want = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    got = R.read_csv(spark, str(tmp_path), SCHEMA, split=True)
    if end == "\n":
        assert canon(got) == canon(want)
    # (Spark's own reader leaves the carriage return of a CRLF file in the last field)
    plain = [row for f in range(2) for row in list(csv.reader(open(tmp_path / f"f{f}.csv", newline="")))[1:] if row]
    assert len(plain) == 600 and canon(got) == sorted(repr((int(a), b or None, c or None)) for a, b, c in plain)
    tasks = ST._pieces(spark, str(tmp_path), "\n").groupBy(F.spark_partition_id().alias("p"), "file").count().groupBy("file").count().collect()
    assert len(tasks) == 2 and all(t["count"] > 5 for t in tasks)


def test_csv_parts_by_shuffle(spark, small_splits, tmp_path, monkeypatch):
    """The branch for more splits than are broadcast."""
    monkeypatch.setattr(ST, "BROADCAST_SPLITS", 0)
    with open(tmp_path / "f.csv", "w", newline="") as out:
        w = csv.writer(out)
        w.writerow(["id", "t", "o"])
        w.writerows([i, "q\n" * (i % 9), "z"] for i in range(400))
    want = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert canon(R.read_csv(spark, str(tmp_path), SCHEMA, split=True)) == canon(want)


def test_empty_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id,the text,other\n")
    assert R.read_csv(spark, str(tmp_path), SCHEMA, split=True).count() == 0


def test_sheet_with_breaks_and_a_foreign_header(spark, small_splits, tmp_path):
    need = "Questions ou Affirmations"
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="") as out:
            w = csv.writer(out)
            w.writerow(["langue", need, "id"])
            w.writerows(["fr", f"line {i}\nnext, \"q\"", i] for i in range(100))
    got = R.read_sheet(spark, str(tmp_path), f"id LONG, `{need}` STRING, langue STRING", need)
    assert sorted((r.id, r[need], r.langue) for r in got.collect()) == sorted((i, f"line {i}\nnext, \"q\"", "fr") for i in range(100) for _ in range(2))
    with open(tmp_path / "g.csv", "w") as out:
        out.write(f"id,{need},langue\n1,x,fr\n")
    with pytest.raises(Exception, match="header does not fit"):
        R.read_sheet(spark, str(tmp_path), f"id LONG, `{need}` STRING, langue STRING", need).collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_equal_the_whole_file_read(spark, small_splits, tmp_path, indent):
    r = random.Random(3)
    for f in range(2):
        blocks = [{"pairs": [{"texte_cible": text(r), "traduction": text(r) if i % 9 else None} for _ in range(r.randrange(4))],
                   "direction": r.choice(["en_dr", "dr_fr", "{}_[", "a}\"{_["])} for i in range(150)]
        blocks[70]["pairs"].append({"texte_cible": "}{\"\\" * 1500, "traduction": "[" * 900})
        (tmp_path / f"f{f}.json").write_text(json.dumps(blocks, indent=indent, ensure_ascii=bool(f)))
    want = CO.block_rows(spark.read.schema(S.BLOCKS_SCHEMA).option("multiLine", True).json(str(tmp_path)))
    assert want.count() > 300 and canon(R.read_blocks(spark, str(tmp_path), multiline=True)) == canon(want)
    tasks = ST._pieces(spark, str(tmp_path), "}").groupBy(F.spark_partition_id().alias("p"), "file").count().groupBy("file").count().collect()
    assert all(t["count"] > 5 for t in tasks)


@pytest.mark.parametrize("indent", [None, 4])
def test_scraped_documents_equal_the_whole_file_read(spark, small_splits, tmp_path, indent):
    r = random.Random(4)
    for f in range(3):
        rows = [{"source_lang": "fr", "source": text(r), "target_lang": "darija", "target": text(r)} for _ in range(150 * f)]
        (tmp_path / f"f{f}.json").write_text(json.dumps({"translations": rows}, indent=indent))
    want = CO.scraped_rows(spark.read.schema(S.SCRAPED_SCHEMA).option("multiLine", True).json(str(tmp_path)))
    assert want.count() == 450 and canon(R.read_scraped(spark, str(tmp_path), multiline=True)) == canon(want)


def test_empty_json(spark, tmp_path):
    for name, body in (("a", "[]"), ("b", ""), ("c", " [ ] \n")):
        (tmp_path / f"{name}.json").write_text(body)
    assert R.read_blocks(spark, str(tmp_path), multiline=True).count() == 0
