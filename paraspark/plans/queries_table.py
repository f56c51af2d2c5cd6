"""Registered queries: G (change sets), H (ordering/numbering/sampling),
I (set operations) and J (validation) over the translation table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.operators import corpus as CO
from paraspark.operators import stored as ST
from paraspark.operators import table as TB
from paraspark.operators.bitmap import rows_in
from paraspark.operators.ranking import with_row_index
from paraspark.plans import adapters as A
from paraspark.plans import pipelines as P
from paraspark.plans import sqltext as Q
from paraspark.plans.queries_text import lines
from paraspark.plans.registry import register
from paraspark.session import remove_folder, shared_path

W = Q.with_
FIELDS = S.PAIR_COLUMNS
COLS = "id, source_lang, source_text, target_lang, target_text"


def _trn(spark, d):
    return TB.normalise_langs(A.translations(spark, d))


LINES_SQL = W(Q.LINES)

# ------------------------------------------------------------------ G group


@register("g1_resume", LINES_SQL + """SELECT DISTINCT l.line, l.lang FROM lines l
  WHERE NOT EXISTS (SELECT 1 FROM lines e WHERE e.pos = 0 AND e.line IS NOT DISTINCT FROM l.line
                                         AND e.lang IS NOT DISTINCT FROM l.lang)""")
def g1_resume(spark, d):
    """Phrases (document lines) not yet translated; the first line of every
    document stands for the already-translated set."""
    ln = lines(spark, d)
    existing = ln.filter(F.col("pos") == 0).select("line", "lang")
    return TB.resume_pending(ln.select("line", "lang"), existing, ["line", "lang"])


G3_OLD_NEW = """old AS (SELECT t.* FROM trn t WHERE t.id IN (SELECT doc_id FROM labels)),
new AS (SELECT min(id) AS id, source_lang, source_text, target_lang, target_text FROM trn GROUP BY ALL)"""
# every row is offered, so equal keys occur among the new rows: the smallest id is inserted
G3_SQL = W(Q.TR, Q.TRN, G3_OLD_NEW) + f"""SELECT {COLS} FROM old
UNION ALL
SELECT n.id, n.source_lang, n.source_text, n.target_lang, n.target_text FROM new n
WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source_lang = n.source_lang AND o.source_text = n.source_text
                  AND o.target_lang = n.target_lang AND o.target_text = n.target_text)"""


@register("g3_insert_if_absent", G3_SQL)
def g3_insert_if_absent(spark, d):
    """Rows of documents that carry labels form the table; every document
    row is offered for insertion, keyed by the four canonical columns; of new
    rows with the same key (copies of a document) the smallest id goes in."""
    t = _trn(spark, d)
    labelled = A.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    old = t.join(labelled, "id", "left_semi")
    return TB.insert_if_absent(old, t, FIELDS, winner="id")


def _changes(spark, d):
    lab = A.table(spark, d, "labels")
    t = _trn(spark, d)
    upd = rows_in(t, lab.filter(F.col("quality") == 1).select(F.col("doc_id").alias("id")), "id")
    # a second, later change of some rows
    seqs = F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    later = F.when(F.col("seq") == 2, " (v2) (v3)").otherwise(" (v2)")
    upd = upd.withColumn("seq", F.explode(seqs)).select(
        "id", "source_lang", "source_text", "target_lang", F.concat("target_text", later).alias("target_text"), "seq")
    unknown = lab.filter(F.col("toxic") == 1).select(
        (F.col("doc_id") + F.lit(10 ** 9)).alias("id"), F.lit("fr").alias("source_lang"), F.lit("x").alias("source_text"),
        F.lit("dr").alias("target_lang"), F.lit("y").alias("target_text"))
    return upd.unionByName(unknown.withColumn("seq", F.lit(1)))


CHANGES_SQL = """ch1 AS (
  SELECT t.id, t.source_lang, t.source_text, t.target_lang, t.target_text || ' (v2)' AS target_text
  FROM trn t WHERE t.id IN (SELECT doc_id FROM labels WHERE quality = 1)
  UNION ALL
  SELECT doc_id + 1000000000 AS id, 'fr', 'x', 'dr', 'y' FROM labels WHERE toxic = 1),
ch_all AS (
  SELECT *, 1 AS seq FROM ch1
  UNION ALL SELECT id, source_lang, source_text, target_lang, target_text || ' (v3)', 2 AS seq FROM ch1 WHERE id % 3 = 0 AND id < 1000000000),
ch AS (SELECT id, source_lang, source_text, target_lang, target_text FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ch_all) WHERE rn = 1)"""


G4_SQL = W(Q.TR, Q.TRN, CHANGES_SQL) + """SELECT t.id,
  CASE WHEN c.id IS NOT NULL THEN c.source_lang ELSE t.source_lang END AS source_lang,
  CASE WHEN c.id IS NOT NULL THEN c.source_text ELSE t.source_text END AS source_text,
  CASE WHEN c.id IS NOT NULL THEN c.target_lang ELSE t.target_lang END AS target_lang,
  CASE WHEN c.id IS NOT NULL THEN c.target_text ELSE t.target_text END AS target_text
  FROM trn t LEFT JOIN ch c ON c.id = t.id"""


@register("g4_update_by_key", G4_SQL)
def g4_update_by_key(spark, d):
    new_table, _ = TB.update_by_key(_trn(spark, d), _changes(spark, d), order="seq")
    return new_table


def _in_place(spark, d, change):
    """The table after ``change(path)``, written in key ranges for this."""
    path = shared_path(spark, f"stored-{uuid.uuid4().hex[:12]}")
    ST.write_ranges(_trn(spark, d), path, width=STORED_WIDTH)
    change(path)
    out = ST.read_ranges(spark, path, S.TRANSLATION_SCHEMA).checkpoint(eager=True)
    remove_folder(spark, path)
    return out


#: keys of a folder of the stored table
STORED_WIDTH = 2_000


@register("g4_update_stored", G4_SQL)
def g4_update_stored(spark, d):
    """The same changes in place: only the folders of changed keys are rewritten."""
    return _in_place(spark, d, lambda path: ST.update_stored(spark, path, _changes(spark, d), S.TRANSLATION_SCHEMA, order="seq", width=STORED_WIDTH))


@register("g4_updated_rows", W(Q.TR, Q.TRN, CHANGES_SQL) + f"SELECT c.* FROM ch c WHERE c.id IN (SELECT id FROM trn)")
def g4_updated_rows(spark, d):
    _, updated = TB.update_by_key(_trn(spark, d), _changes(spark, d), order="seq")
    return updated


def _deleted_keys(spark, d):
    return A.table(spark, d, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))


@register("g5_delete_by_key", W(Q.TR, Q.TRN) + f"SELECT {COLS} FROM trn WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def g5_delete_by_key(spark, d):
    remaining, _ = TB.delete_by_key(_trn(spark, d), _deleted_keys(spark, d))
    return remaining


@register("g5_delete_stored", W(Q.TR, Q.TRN) + f"SELECT {COLS} FROM trn WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def g5_delete_stored(spark, d):
    """The same deletion in place."""
    return _in_place(spark, d, lambda path: ST.delete_stored(spark, path, _deleted_keys(spark, d), S.TRANSLATION_SCHEMA, width=STORED_WIDTH))


@register("g5_deleted_rows", W(Q.TR, Q.TRN) + f"SELECT {COLS} FROM trn WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def g5_deleted_rows(spark, d):
    _, deleted = TB.delete_by_key(_trn(spark, d), _deleted_keys(spark, d))
    return deleted


G6_NEW = f"""newrows AS (
  SELECT item_id, 'fr' AS source_lang, text AS source_text, 'dr' AS target_lang, {Q.target_of('text')} AS target_text
  FROM benchmark),
valid AS (
  SELECT * FROM newrows
  WHERE source_text IS NOT NULL AND target_text IS NOT NULL
    AND length(source_text) BETWEEN 1 AND 500 AND length(target_text) BETWEEN 1 AND 500)"""


@register("g6_create", W(Q.TR, Q.TRN, G6_NEW) + """SELECT (SELECT max(id) FROM trn) + row_number() OVER (ORDER BY item_id) AS id,
  source_lang, source_text, target_lang, target_text FROM valid""")
def g6_create(spark, d):
    """Benchmark items offered as new fr->dr rows; invalid ones (J1/J2) are
    not created; ids continue after the current maximum."""
    b = A.table(spark, d, "benchmark")
    new = b.select("item_id", F.lit("fr").alias("source_lang"), F.col("text").alias("source_text"),
                   F.lit("dr").alias("target_lang"), A.target_of(F.col("text")).alias("target_text"))
    _, created = TB.create_rows(_trn(spark, d), new, ["item_id"])
    return created


@register("g7_unique_check", W(Q.TR, Q.TRN) + """SELECT source_lang, source_text, target_lang, target_text, count(*) AS occurrences
  FROM trn WHERE source_lang IS NOT NULL AND source_text IS NOT NULL AND target_lang IS NOT NULL AND target_text IS NOT NULL
  GROUP BY ALL HAVING count(*) > 1""")
def g7_unique_check(spark, d):
    return TB.duplicate_keys(_trn(spark, d), row_key="id")


# ------------------------------------------------------------------ H group

@register("h1_newest_first", W(Q.TR, Q.TRN) + "SELECT id, source_lang, target_lang FROM trn ORDER BY id DESC")
def h1_newest_first(spark, d):
    return TB.newest_first(_trn(spark, d)).select("id", "source_lang", "target_lang")


@register("h2_largest_group", W(Q.TR, Q.TRN) + "SELECT target_lang, count(*) AS total FROM trn GROUP BY target_lang ORDER BY total DESC, target_lang")
def h2_largest_group(spark, d):
    return (_trn(spark, d).groupBy("target_lang").agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.desc("total"), "target_lang"))


@register("h3_dense_ids", LINES_SQL + "SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) AS row_index FROM lines")
def h3_dense_ids(spark, d):
    return with_row_index(lines(spark, d).select("doc_id", "pos"), ["doc_id", "pos"], "row_index")


SPLIT_SQL = f"""ranked AS (
  SELECT id, row_number() OVER (ORDER BY md5('{S.SPLIT_SEED}:' || CAST(id AS VARCHAR)), id) AS rk,
         count(*) OVER () AS n FROM trn),
split AS (SELECT id, rk, CASE WHEN rk <= ceil({S.TEST_FRACTION} * n) THEN 'test' ELSE 'train' END AS split FROM ranked)"""


@register("h4_split", W(Q.TR, Q.TRN, SPLIT_SQL) + "SELECT id, split FROM split")
def h4_split(spark, d):
    return CO.split_train_test(_trn(spark, d), "id").select("id", "split")


@register("h5_seeded_sample", W(Q.TR, Q.TRN, SPLIT_SQL) + f"SELECT id FROM ranked ORDER BY rk LIMIT {S.PREVIEW_K}")
def h5_seeded_sample(spark, d):
    return CO.seeded_sample(_trn(spark, d), "id", S.PREVIEW_K).select("id")


@register("h6_eval_cap", W(Q.TR, Q.TRN, SPLIT_SQL) + f"SELECT id FROM split WHERE split = 'test' ORDER BY rk LIMIT {S.EVAL_CAP}")
def h6_eval_cap(spark, d):
    test = CO.split_train_test(_trn(spark, d), "id").filter(F.col("split") == "test")
    return CO.seeded_sample(test, "id", S.EVAL_CAP).select("id")


@register("h7_batches", LINES_SQL + f"""SELECT batch, count(*) AS items FROM (
  SELECT (row_number() OVER (ORDER BY doc_id, pos) - 1) // {S.QUESTION_BATCH} AS batch, row_number() OVER (ORDER BY doc_id, pos) AS rn FROM lines)
  WHERE rn <= (SELECT count(*) - count(*) // 7 FROM lines) GROUP BY batch""")
def h7_batches(spark, d):
    """A request for six sevenths of the lines: the last batch is smaller."""
    ln = lines(spark, d)
    n = ln.count()
    return CO.batches(ln, ["doc_id", "pos"], n=n - n // 7)


# ------------------------------------------------------------------ I group

def _scraped_and_processed(spark, d):
    t = A.translations(spark, d)
    doc = t.select(F.array(F.struct(F.col("source_lang"), F.col("source_text").alias("source"),
                                    F.col("target_lang"), F.col("target_text").alias("target"))).alias("translations"))
    scraped = CO.scraped_rows(doc)
    processed = P.flat_pairs_long(A.sample_turns(spark, d))
    return scraped, processed


I_U = """u AS (
  SELECT source_lang, source_text, target_lang, target_text, 0 AS source_ord FROM trn
  UNION ALL SELECT source_lang, source_text, target_lang, target_text, 1 AS source_ord FROM flat)"""
I_SQL = W(Q.TR, Q.TRN, Q.TURNS, Q.SAMPLES, Q.greedy_ctes(), Q.FLAT_PAIRS, I_U)


@register("i1_union_all", I_SQL + "SELECT * FROM u")
def i1_union_all(spark, d):
    return CO.union_sources(*_scraped_and_processed(spark, d))


@register("i2_union_distinct", I_SQL + "SELECT source_lang, source_text, target_lang, target_text, min(source_ord) AS source_ord FROM u GROUP BY ALL")
def i2_union_distinct(spark, d):
    return CO.union_distinct(*_scraped_and_processed(spark, d))


# ------------------------------------------------------------------ J group

def _viol_sql() -> str:
    langs = ", ".join(Q.q(x) for x in S.TABLE_LANGS)

    def bad_lang(c):
        return f"NOT coalesce({c} IN ({langs}), false)"

    def bad_text(c):
        return f"NOT coalesce(length({c}) BETWEEN {S.TEXT_MIN_CHARS} AND {S.TEXT_MAX_CHARS}, false)"

    same = f"(NOT ({bad_lang('source_lang')}) AND NOT ({bad_lang('target_lang')}) AND source_lang = target_lang)"
    parts = [(bad_lang("source_lang"), "source_lang"), (bad_lang("target_lang"), "target_lang"),
             (bad_text("source_text"), "source_text"), (bad_text("target_text"), "target_text"), (same, "same_language")]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN {Q.q(n)} END" for c, n in parts) + ")"


J_TABLE = """jt AS (
  SELECT id, source_lang, source_text, target_lang, target_text FROM tr
  UNION ALL SELECT id + 1000000000, source_lang, source_text, source_lang, target_text FROM trn)"""


def _jt(spark, d):
    """Raw rows (aliases not normalised) plus normalised rows whose target
    language is forced equal to the source, so every rule fires somewhere."""
    raw = A.translations(spark, d)
    same = _trn(spark, d).select((F.col("id") + F.lit(10 ** 9)).alias("id"), "source_lang", "source_text",
                                 F.col("source_lang").alias("target_lang"), "target_text")
    return raw.unionByName(same)


@register("j1_validate", W(Q.TR, Q.TRN, J_TABLE) + f"SELECT id, {_viol_sql()} AS violations FROM jt")
def j1_validate(spark, d):
    return TB.with_violations(_jt(spark, d)).select("id", F.array_join("violations", ",").alias("violations"))


@register("j2_required", """SELECT d.doc_id, (d.text IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL) AS present
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j2_required(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    lab = A.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(lab, "doc_id", "left")
    return j.select("doc_id", TB.required_present(["text", "quality", "toxic"]).alias("present"))


@register("j3_violation_counts", W(Q.TR, Q.TRN, J_TABLE) + f"""SELECT rule, count(*) AS rows FROM (
  SELECT unnest(string_split({_viol_sql()}, ',')) AS rule FROM jt) WHERE rule <> '' GROUP BY rule""")
def j3_violation_counts(spark, d):
    return TB.violation_counts(_jt(spark, d))
