"""CRUD sequence over the translation table (G3-G7, C2-C4, J1-J3): absent keys
give empty results, like the reference's 404s."""

from pyspark.sql import functions as F

from paraspark.operators import table as TB
from paraspark.schemas import TRANSLATION_SCHEMA

ROWS = [(1, "fr", "Bonjour", "dr", "السلام عليكم"), (2, "en", "Thanks", "dr", "شكرا"), (3, "dr", "Test x", "fr", "y")]


def table(spark):
    return spark.createDataFrame(ROWS, TRANSLATION_SCHEMA)


def test_create_get_update_delete(spark):
    t = table(spark)
    new = spark.createDataFrame([(10, "fr", "Merci", "dr", "شكرا"), (11, "fr", "x", "ar", "y")],
                                "item int, source_lang string, source_text string, target_lang string, target_text string")
    t2, created = TB.create_rows(t, new, ["item"])
    c = created.collect()
    assert len(c) == 1 and c[0]["id"] == 4 and c[0]["target_lang"] == "dr"  # 'ar' is rejected
    assert TB.get_by_id(t2, 4).count() == 1
    changes = spark.createDataFrame([(4, "fr", "Merci", "dr", "شكراً"), (99999, "fr", "a", "dr", "b")], TRANSLATION_SCHEMA)
    t3, updated = TB.update_by_key(t2, changes)
    assert [r["id"] for r in updated.collect()] == [4]
    assert TB.get_by_id(t3, 4).first()["target_text"] == "شكراً"
    t4, deleted = TB.delete_by_key(t3, spark.createDataFrame([(4,)], "id long"))
    assert [r["id"] for r in deleted.collect()] == [4]
    assert TB.get_by_id(t4, 4).count() == 0


def test_absent_id(spark):
    t = table(spark)
    assert TB.get_by_id(t, 99999).count() == 0
    _, upd = TB.update_by_key(t, spark.createDataFrame([(99999, "fr", "a", "dr", "b")], TRANSLATION_SCHEMA))
    assert upd.count() == 0
    rest, gone = TB.delete_by_key(t, spark.createDataFrame([(99999,)], "id long"))
    assert gone.count() == 0 and rest.count() == 3


def test_optional_filters_and_prefix_cleanup(spark):
    t = table(spark)
    assert TB.filter_langs(t).count() == 3
    assert TB.filter_langs(t, source_lang="fr").count() == 1
    assert TB.filter_langs(t, target_lang="dr").count() == 2
    assert [r["id"] for r in TB.delete_prefixed(t).collect()] == [1, 2]


def test_validation_rules(spark):
    rows = [(1, "fr", "ok", "dr", "ok"), (2, "fr", "", "fr", "x" * 501), (3, "xx", "a", "fr", "b"), (4, None, None, "dr", "b")]
    t = spark.createDataFrame(rows, TRANSLATION_SCHEMA)
    v = {r["id"]: r["violations"] for r in TB.with_violations(t).collect()}
    assert v[1] == []
    assert v[2] == ["source_text", "target_text", "same_language"]
    assert v[3] == ["source_lang"]
    assert v[4] == ["source_lang", "source_text"]
    counts = {r["rule"]: r["rows"] for r in TB.violation_counts(t).collect()}
    assert counts["source_lang"] == 2


def test_insert_if_absent_and_unique(spark):
    t = table(spark)
    new = spark.createDataFrame([(7, "fr", "Bonjour", "dr", "السلام عليكم"), (8, "fr", "Salut", "dr", "x"),
                                 (9, None, "n", "dr", "x")], TRANSLATION_SCHEMA)
    merged = TB.insert_if_absent(t, new, ["source_lang", "source_text", "target_lang", "target_text"])
    assert sorted(r["id"] for r in merged.collect()) == [1, 2, 3, 8, 9]
    assert TB.duplicate_keys(merged.union(merged.filter(F.col("id") == 1))).count() == 1


def test_resume_pending_is_set_membership(spark):
    from paraspark.operators.table import resume_pending
    phrases = spark.createDataFrame([("a", "fr"), ("a", "fr"), ("b", "fr"), ("c", None), ("d", None)],
                                    "line string, lang string")
    existing = spark.createDataFrame([("b", "fr"), ("c", None), ("z", "en")], "line string, lang string")
    got = sorted(tuple(r) for r in resume_pending(phrases, existing, ["line", "lang"]).collect())
    # a repeated phrase once; NULL equals NULL like a Python set; keys only in existing never appear
    assert got == [("a", "fr"), ("d", None)]


ROW = "id LONG, source_lang STRING, source_text STRING, target_lang STRING, target_text STRING"


def test_repeats_among_new_rows_go_in_once(spark):
    old = spark.createDataFrame([(1, "fr", "a", "dr", "b")], ROW)
    new = spark.createDataFrame([(9, "fr", "c", "dr", "d"), (5, "fr", "c", "dr", "d"), (7, "fr", "a", "dr", "b"),
                                 (3, None, "c", "dr", "d"), (4, None, "c", "dr", "d")], ROW)
    out = TB.insert_if_absent(old, new, TB.FIELDS, winner="id")
    assert sorted(r["id"] for r in out.collect()) == [1, 3, 4, 5]
    assert TB.duplicate_keys(out).count() == 0


def test_several_changes_of_one_key(spark):
    table = spark.createDataFrame([(1, "fr", "a", "dr", "b"), (2, "fr", "x", "dr", "y")], ROW)
    ch = spark.createDataFrame([(1, "fr", "a", "dr", "second", 2), (1, "fr", "a", "dr", "first", 1), (8, "fr", "q", "dr", "q", 1)], ROW + ", seq INT")
    new, updated = TB.update_by_key(table, ch, order="seq")
    assert sorted((r["id"], r["target_text"]) for r in new.collect()) == [(1, "second"), (2, "y")]
    assert [(r["id"], r["target_text"]) for r in updated.collect()] == [(1, "second")]


def test_newest_first_order(spark):
    df = spark.range(50).repartition(7)
    assert [r["id"] for r in TB.newest_first(df).collect()] == list(range(49, -1, -1))
