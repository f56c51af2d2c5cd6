"""Incremental ingest (L1, L2): equals the batch result, and a replayed
arrival adds nothing."""

import os
import re
import shutil
import tempfile
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paraspark.sources import loads as LD
from paraspark.streaming import ingest as ST

SCHEMA = StructType([StructField(c, StringType()) for c in ["source_lang", "source_text", "target_lang", "target_text"]])
KEYS = [f.name for f in SCHEMA.fields]


def _arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)


FIRST = [("fr", "a", "dr", "x"), ("fr", "a", "dr", "x"), ("en", "b", "dr", "y")]
SECOND = [("fr", "a", "dr", "x"), ("en", "c", "dr", None), ("en", "c", "dr", None), ("en", "c", "dr", "")]
EXPECTED = {("fr", "a", "dr", "x"), ("en", "b", "dr", "y"), ("en", "c", "dr", None), ("en", "c", "dr", "")}


def _paths(kind):
    base = tempfile.mkdtemp(prefix="paraspark-stream-")
    return [os.path.join(base, kind, p) for p in ("in", "out", "ck")]


def _ingest(spark, kind, src, out, ck, **more):
    if kind == "l1":
        return ST.ingest_dedup(spark, src, SCHEMA, lambda d: d, KEYS, out, ck, SCHEMA, **more)
    return ST.ingest_anti_join(spark, src, SCHEMA, lambda d: d, KEYS, out, ck, SCHEMA, **more)


def _rows(spark, out):
    return [tuple(r) for r in ST.read_target(spark, out, SCHEMA).collect()]


@pytest.mark.parametrize("kind", ["l1", "l2"])
def test_l1_and_l2_idempotent(spark, kind):
    src, out, ck = _paths(kind)
    for rows in (FIRST, SECOND, []):
        if rows:
            _arrive(spark, src, rows)
        _ingest(spark, kind, src, out, ck, max_files_per_trigger=1)
    got = _rows(spark, out)
    assert len(got) == len(EXPECTED) and set(got) == EXPECTED


@pytest.mark.parametrize("kind", ["l1", "l2"])
@pytest.mark.parametrize("published", [True, False])
def test_replayed_batch_adds_nothing(spark, kind, published):
    """A crash before the batch commit, after the load was published or
    before: the restarted query replays the batch from its offset log."""
    src, out, ck = _paths(kind)
    _arrive(spark, src, FIRST)
    _ingest(spark, kind, src, out, ck)
    assert os.listdir(os.path.join(ck, "commits"))
    want = sorted(map(repr, _rows(spark, out)))
    # the state a crash in the first batch leaves: its offsets written, its commit missing
    crashed = ck + "_crashed"
    shutil.copytree(ck, crashed, ignore=lambda d, names: ["commits"] if d == ck else
                    [n for n in names if d.endswith("offsets") and n.strip(".").split(".")[0] != "0"])
    if not published:
        shutil.rmtree(os.path.join(out, "_published"))
        assert _rows(spark, out) == []
    _ingest(spark, kind, src, out, crashed)
    assert os.listdir(os.path.join(crashed, "commits"))  # the batch ran again
    assert sorted(map(repr, _rows(spark, out))) == want


def test_two_queries_into_one_target(spark):
    """A query with a checkpoint of its own neither repeats nor overwrites rows."""
    src, out, ck = _paths("l2")
    _arrive(spark, src, FIRST)
    _ingest(spark, "l2", src, out, ck)
    other = src + "2"
    _arrive(spark, other, SECOND)
    _ingest(spark, "l1", other, out, ck + "2")
    got = _rows(spark, out)
    assert len(got) == len(EXPECTED) and set(got) == EXPECTED


def test_a_batch_reads_only_the_index_folders_it_touches(spark):
    src, out, ck = _paths("l2")
    _arrive(spark, src, [("fr", f"t{i}", "dr", "x") for i in range(500)])
    _ingest(spark, "l2", src, out, ck)
    index = ST.index_path(out)
    folders = [f for d, names, _ in os.walk(index) for f in names if f.startswith(ST.PREFIX)]
    assert len(set(folders)) == ST.PREFIXES
    known = ST.known_digests(spark, out, [3, 9])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*_prefix#\d+ IN \(3,9\)", plan)
    files = {r[0] for r in known.select(F.input_file_name()).distinct().collect()}
    assert files and all("_prefix=3/" in f or "_prefix=9/" in f for f in files)
    assert ST.known_digests(spark, out, list(range(ST.PREFIXES))).count() == 500


def test_l1_state_stays_bounded(spark):
    """Ten deliveries of new rows: the state holds the last arrivals, the
    target all of them, and a late repeat of the first delivery adds nothing."""
    src, out, ck = _paths("l1")
    held = []
    for k in [*range(10), 0]:
        _arrive(spark, src, [("fr", f"t{k}-{i}", "dr", "x") for i in range(40)] * 2)
        q = _ingest(spark, "l1", src, out, ck, remember="0 seconds")
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
        time.sleep(0.05)
    assert len(_rows(spark, out)) == len(set(_rows(spark, out))) == 400
    assert max(held) <= 2 * 40, held


def test_compacted_target_keeps_its_rows(spark):
    src, out, ck = _paths("l2")
    for k in range(4):
        _arrive(spark, src, [("fr", f"t{k}-{i}", "dr", "x") for i in range(20)])
        _ingest(spark, "l2", src, out, ck)
    before = sorted(_rows(spark, out))
    ST.compact_target(spark, out, SCHEMA)
    assert len(LD.published(spark, out)) == 1 and sorted(_rows(spark, out)) == before
    ST.vacuum_target(spark, out)
    for folder in (out, ST.index_path(out)):
        assert len([f for f in os.listdir(folder) if f.startswith("load=")]) == 1
    assert sorted(_rows(spark, out)) == before
    _arrive(spark, src, [("fr", f"t{k}-{i}", "dr", "x") for k in range(5) for i in range(20)])
    _ingest(spark, "l2", src, out, ck)
    got = _rows(spark, out)
    assert len(got) == len(set(got)) == 100
