"""Sources and sinks: required columns, CSV round trip, metric-log layout."""

import os
import tempfile

import pytest

from paraspark.sources import readers as R
from paraspark.sources import writers as W


def test_required_column_missing(spark):
    path = tempfile.mkdtemp(prefix="paraspark-sheet-") + "/s"
    spark.createDataFrame([(1, "q")], "id int, other string").write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        R.read_sheet(spark, path, "id int, other string", "Questions ou Affirmations")


def test_csv_round_trip_keeps_spaces_and_newlines(spark):
    path = tempfile.mkdtemp(prefix="paraspark-csv-") + "/c"
    rows = [(1, ' a "q"\nb '), (2, "")]
    W.write_csv(spark.createDataFrame(rows, "id int, t string"), path)
    got = dict(tuple(r) for r in R.read_csv(spark, path, "id int, t string").collect())
    assert got[1] == ' a "q"\nb '
    assert got[2] is None  # an empty string comes back as NULL


def test_metric_log_layout(spark):
    root = tempfile.mkdtemp(prefix="paraspark-mlruns-")
    d = os.path.join(root, "0", "abc123", "metrics")
    os.makedirs(d)
    with open(os.path.join(d, "eval_bleu"), "w") as f:
        f.write("1700000000000 7.33 2000\n1700000001000 18.25 42000\n")
    got = R.read_metric_logs(spark, root).orderBy("step").collect()
    assert [(r["run_id"], r["metric"], r["value"], r["step"]) for r in got] == [
        ("abc123", "eval_bleu", 7.33, 2000), ("abc123", "eval_bleu", 18.25, 42000)]


def test_metric_log_lines_parse_as_csv(spark):
    """Blank lines, a short, a long and a damaged line give what the CSV reader gives."""
    from paraspark import schemas as S
    d = os.path.join(tempfile.mkdtemp(prefix="paraspark-mlruns-"), "r", "metrics")
    os.makedirs(d)
    with open(os.path.join(d, "loss"), "w") as f:
        f.write("1 0.5 2\n\n  \n3 x 4\n5 6.5\n7 8.5 9 10\n 1 2\r\n\t\n1  3\n")
    want = spark.read.schema(S.METRIC_LOG_SCHEMA).option("sep", " ").csv(d).collect()
    got = R.read_metric_logs(spark, d).select("ts_ms", "value", "step").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 4


def test_metric_logs_written_by_the_tasks(spark):
    """Same folders and rows as Spark's writer, without a Hadoop file (and its
    checksum file and processes) per run and metric."""
    rows = [(r, m, i, v, i) for i, (r, m, v) in enumerate(
        (r, m, v) for r in ("run1", "a b", "x/y=é", "", None) for m in ("loss", "m:1", None) for v in (0.1, None, float("nan")))]
    df = spark.createDataFrame(rows, "run_id string, metric string, ts_ms long, value double, step long")
    root = tempfile.mkdtemp(prefix="paraspark-a9-")
    W.write_metric_logs(df, root + "/own")
    df.write.partitionBy("run_id", "metric").option("sep", " ").csv(root + "/spark")

    def folders(at):
        return {os.path.relpath(d, at) for d, _, names in os.walk(at) if any(n.startswith("part-") for n in names) and d != at}

    def read(at):
        return sorted(map(str, R.read_metric_logs(spark, at, ".*/run_id=([^/]+)/metric=[^/]+/[^/]+$", ".*/metric=([^/]+)/[^/]+$").collect()))

    assert folders(root + "/own") == folders(root + "/spark") and len(folders(root + "/own")) == 12
    assert read(root + "/own") == read(root + "/spark") and len(read(root + "/own")) == len(rows)
    files = [os.path.join(d, n) for d, _, names in os.walk(root + "/own") for n in names if d != root + "/own"]
    assert len(files) == 12 and all(os.path.basename(f).startswith("part-") for f in files)
    with pytest.raises(Exception):
        W.write_metric_logs(df, root + "/own")
    W.write_metric_logs(df, root + "/own", mode="append")
    assert len(read(root + "/own")) == 2 * len(rows)
    W.write_metric_logs(df, root + "/own", mode="ignore")
    assert len(read(root + "/own")) == 2 * len(rows)
    W.write_metric_logs(df.limit(0), root + "/own", mode="overwrite")
    assert read(root + "/own") == []


def _by_spark(spark, path):
    from pyspark.sql import functions as F
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return sorted(tuple(r) for r in lines.select("_metadata.file_path", "value").filter(F.length("value") > 0).collect())


def _by_tasks(spark, path):
    import re

    from paraspark.sources import many_files as MF
    return sorted((r["file"], line) for r in MF.read_lines(spark, path).collect() for line in re.split("[\r\n]+", r["text"]) if line)


@pytest.fixture
def odd_files():
    """Names that Spark quotes or skips, line ends of all kinds, a compressed file."""
    import gzip
    root = tempfile.mkdtemp(prefix="paraspark odd-")
    names = ["a b", "x%2Fy", "é", "e\u0301", "h#1", "q?x", "[b]{c}", "*", "t;u,v", "@&+$!~'()", "nb\u00a0sp", "\u2028ls", "tab\tx", "back\\s",
             'q"uo', "^p|`<>", "\u0085", "😀", "_x=1", "_metadata", "_hid", ".dot", "z._COPYING_"]
    for n in names:
        os.makedirs(os.path.join(root, n, "empty"))
        for file in (n, "deep/" + n, "loss"):
            os.makedirs(os.path.dirname(os.path.join(root, n, file)), exist_ok=True)
            with open(os.path.join(root, n, file), "wb") as f:
                f.write(b"\xef\xbb\xbf1 2 3\r\n\n4 5 6\r7 8 9")
    open(os.path.join(root, "none"), "w").close()
    os.symlink("nowhere", os.path.join(root, "broken"))
    os.symlink("a b", os.path.join(root, "linked"))
    with gzip.open(os.path.join(root, "packed.gz"), "wb") as f:
        f.write(b"1 2 3\n4 5 6\n")
    return root


def test_many_files_give_the_lines_of_sparks_reader(spark, odd_files):
    want = _by_spark(spark, odd_files)
    assert len(want) > 100 and _by_tasks(spark, odd_files) == want
    assert _by_tasks(spark, "file://" + odd_files) == _by_spark(spark, "file://" + odd_files)
    one = os.path.join(odd_files, "packed.gz")
    assert _by_tasks(spark, one) == _by_spark(spark, one)
    with pytest.raises(Exception):
        _by_tasks(spark, odd_files + "-missing")


def test_many_files_of_another_store_are_read_in_groups(spark, odd_files, monkeypatch):
    from paraspark.sources import many_files as MF
    monkeypatch.setattr(MF, "local_folder", lambda *_: None)
    monkeypatch.setattr(MF, "PER_GROUP", 7)
    os.unlink(os.path.join(odd_files, "broken"))
    assert _by_tasks(spark, odd_files) == _by_spark(spark, odd_files)
    assert _by_tasks(spark, tempfile.mkdtemp(prefix="paraspark-none-")) == []


def test_a_large_log_is_read_in_parts(spark, monkeypatch):
    """Every line once, wherever the parts are cut."""
    from paraspark.sources import many_files as MF
    data = b"".join(b"%d 1 2%s" % (i, (b"\n", b"\r\n", b"\r", b"\n\n")[i % 4]) for i in range(40)) + b"last"
    want = [line for line in data.splitlines() if line]
    name = os.path.join(tempfile.mkdtemp(prefix="paraspark-parts-"), "f")
    with open(name, "wb") as f:
        f.write(data)
    for size in (1, 2, 3, 5, 7, 11, 50, len(data), 10_000):
        for text in (1, 3, 8, 64, 10_000):
            monkeypatch.setattr(MF, "TEXT_BYTES", text)
            with open(name, "rb", buffering=0) as f:
                got = [line for at in range(0, len(data), size) for t in MF.texts_of(f, at, at + size) for line in t.splitlines() if line]
            assert got == want, (size, text)
    monkeypatch.undo()
    monkeypatch.setattr(MF, "SPLIT_BYTES", 50)
    assert [v for _, v in _by_tasks(spark, os.path.dirname(name))] == [v for _, v in _by_spark(spark, os.path.dirname(name))]


def test_metric_logs_are_not_listed_on_the_driver(spark):
    """The driver's plan holds no file, and tasks do not grow by one for every 32 files."""
    root = tempfile.mkdtemp(prefix="paraspark-mlruns-")
    for i in range(1200):
        d = os.path.join(root, "0", f"r{i}", "metrics")
        os.makedirs(d)
        with open(os.path.join(d, "loss"), "w") as f:
            f.write(f"{i} 0.5 {i}\n")
    got = R.read_metric_logs(spark, root)
    assert got.inputFiles() == [] and got.rdd.getNumPartitions() == 1
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"r{i}", "loss", i, 0.5, i) for i in range(1200))


def test_a_wide_folder_is_removed_by_tasks(spark, monkeypatch):
    from paraspark.sources import many_files as MF
    monkeypatch.setattr(MF, "PER_TASK", 5)
    root = tempfile.mkdtemp(prefix="paraspark-wide-")
    for n in [".h", *map(str, range(20))]:
        os.makedirs(os.path.join(root, n, "x"))
        open(os.path.join(root, n, "x", "f"), "w").close()
        open(os.path.join(root, n + "f"), "w").close()
    MF.remove_files(spark, root)
    assert not os.path.exists(root)
    MF.remove_files(spark, root)


def test_scraped_document_per_file(spark):
    import json
    d = tempfile.mkdtemp(prefix="paraspark-scraped-")
    doc = {"translations": [
        {"source_lang": "fr", "source": "Bonjour", "target_lang": "darija", "target": "سلام"},
        {"source_lang": "EN", "source": "Thanks", "target_lang": "Darija", "target": "شكرا"}]}
    with open(os.path.join(d, "translations.json"), "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2)
    got = sorted(tuple(r) for r in R.read_scraped(spark, d, multiline=True).collect())
    assert got == [("en", "Thanks", "dr", "شكرا"), ("fr", "Bonjour", "dr", "سلام")]


def test_blocks_json_array_per_file(spark):
    import json
    d = tempfile.mkdtemp(prefix="paraspark-blocks-")
    blocks = [{"pairs": [{"texte_cible": "A", "traduction": "B"}, {"texte_cible": "C", "traduction": ""}],
               "direction": "fr_dr"},
              {"pairs": [], "direction": "dr_en"}]
    with open(os.path.join(d, "traductions_processed.json"), "w", encoding="utf-8") as f:
        json.dump(blocks, f, ensure_ascii=False, indent=2)
    got = sorted(tuple(r) for r in R.read_blocks(spark, d, multiline=True).collect())
    assert got == [("fr", "A", "dr", "B"), ("fr", "C", "dr", "")]


def test_quarantine_split(spark):
    path = tempfile.mkdtemp(prefix="paraspark-q-") + "/q"
    df = spark.createDataFrame([("1", True), ("2", False), ("3", False)], "id string, problem boolean")
    W.write_quarantine(df, path)
    assert {"problem=true", "problem=false"} <= set(os.listdir(path))
    back = spark.read.schema("id string, problem boolean").json(path)
    assert sorted((r["id"], r["problem"]) for r in back.collect()) == [("1", True), ("2", False), ("3", False)]


def test_stored_table_prunes_by_language_pair(spark, sf_small):
    """B5 lays the table out by language pair; C2 on the stored table is a
    partition filter (other pairs' files are never opened)."""
    import tempfile

    from paraspark.operators import table as TB
    from paraspark.plans import queries_io as QI
    from paraspark.sources import writers as Wr
    path = tempfile.mkdtemp(prefix="paraspark-b5-") + "/t"
    rows = QI._trn(spark, sf_small)
    W.bulk_append(rows, path, partition_by=QI.TABLE_PARTITION)
    stored = spark.read.parquet(path)
    q = TB.filter_langs(stored, source_lang="dr", target_lang=None)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_lang" in plan and "(source_lang" in plan
    assert q.count() == rows.filter("source_lang = 'dr'").count()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_required_column_is_looked_for_in_the_files(spark, fmt, tmp_path):
    """A schema that names the column does not make up for files without it."""
    schema = "id int, `Questions ou Affirmations` string"
    bad, good = str(tmp_path / "bad"), str(tmp_path / "good")
    df = spark.createDataFrame([(1, "a")], "id int, Other string")
    (df.write.option("header", True) if fmt == "csv" else df.write).format(fmt).save(bad)
    with pytest.raises(ValueError):
        R.read_sheet(spark, bad, schema, "Questions ou Affirmations", fmt=fmt)
    # other order than the schema's: matched by name
    df = spark.createDataFrame([("phrase", "x", 7)], "`Questions ou Affirmations` string, more string, id int")
    (df.write.option("header", True) if fmt == "csv" else df.write).format(fmt).save(good)
    row = R.read_sheet(spark, good, schema, "Questions ou Affirmations", fmt=fmt).first()
    assert (row["id"], row["Questions ou Affirmations"], row["more"]) == (7, "phrase", "x")


def test_blank_folder_values_survive(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "", "a", "fr", "b"), (2, "007", "a", "2020-01-01", "b"), (3, None, "a", "", "b")]
    schema = "id LONG, source_lang STRING, source_text STRING, target_lang STRING, target_text STRING"
    W.bulk_append(spark.createDataFrame(rows, schema), path, ["source_lang", "target_lang"])
    t = R.read_table(spark, "blank_folders", path, schema, ["source_lang", "target_lang"])
    assert sorted(tuple(r) for r in t.select("id", "source_lang", "source_text", "target_lang", "target_text").collect()) == rows
    plan = t.filter("source_lang = ''")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan


def test_escaped_breaks_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    texts = ["a\nb", "a\\nb", "\r\n", "\\", "\\\\n", 'q"uote, comma', "tab\tend\\"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    W.write_csv(df, path, escape_breaks=True)
    got = R.read_csv(spark, path, df.schema, escaped_breaks=True).orderBy("id").collect()
    assert [r["t"] for r in got] == texts


def test_valid_rows_only(spark, tmp_path):
    path = str(tmp_path / "j")
    W.write_json_records(spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, problem boolean"), path, flag="problem")
    assert sorted(r["id"] for r in spark.read.json(path).collect()) == [2, 3] and spark.read.json(path).columns == ["id"]


def test_sheet_files_are_bounded(spark, monkeypatch, tmp_path):
    """One language's lines: several files, written by the tasks that number
    them (before, one file by the one task of the language)."""
    from paraspark.plans import queries_io as Q
    from paraspark.sources import writers
    monkeypatch.setattr(writers, "SHEET_ROWS", 20)
    docs = [(i, "en", "a\nb\nc") for i in range(40)] + [(40, "fr", "d"), (41, None, "e")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sheet = Q._sheet(spark, str(tmp_path))
    out = str(tmp_path / "sheet")
    writers.write_sheet(sheet, out)
    files = [os.path.join(r, f) for r, _, fs in os.walk(out + "/langue=en") for f in fs if f.endswith(".csv")]
    assert len(files) >= 6 and all(sum(1 for _ in open(f)) <= 21 for f in files)
    got = spark.read.option("header", True).schema("id LONG, line STRING, langue STRING").csv(out).collect()
    assert sorted(map(tuple, got)) == sorted([(3 * i + j + 1, c, "en") for i in range(40) for j, c in enumerate("abc")] + [(1, "d", "fr")])
    plan = sheet._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [lang" in plan and "hashpartitioning(lang" not in plan
