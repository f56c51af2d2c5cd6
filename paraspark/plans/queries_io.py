"""Registered queries: A (sources), B (sinks) and L (streaming).

Each writes what it needs to a fresh folder under the shared checkpoint
directory (``spark.checkpoint.dir``), reads it back through the operator
under test and returns the result, so the check compares data that made the
full round trip."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from paraspark import schemas as S
from paraspark.functions import chat as C
from paraspark.functions import lang as L
from paraspark.functions import text as T
from paraspark.operators import corpus as CO
from paraspark.operators import profile as PR
from paraspark.operators import table as TB
from paraspark.operators.digest import BROADCAST_ROWS
from paraspark.plans import adapters as A
from paraspark.plans import pipelines as P
from paraspark.plans import sqltext as Q
from paraspark.plans.queries_chat import REC_SQL, _avail_sql
from paraspark.plans.queries_text import lines
from paraspark.plans.registry import register
from paraspark.session import shared_path
from paraspark.sources import loads as LD
from paraspark.sources import many_files as MF
from paraspark.sources import readers as R
from paraspark.sources import writers as Wr
from paraspark.streaming import ingest as ST

W = Q.with_
FIELDS = S.PAIR_COLUMNS


_STAGED: list[str] = []


def _fresh(spark, tag: str) -> str:
    path = shared_path(spark, f"io-{tag}-{uuid.uuid4().hex[:12]}")
    _STAGED.append(path)
    return path


def staged(fn):
    """A query whose staged folders go once its result has been read from them."""
    @wraps(fn)
    def run(spark, d):
        before = len(_STAGED)
        out = fn(spark, d).checkpoint(eager=True)
        while len(_STAGED) > before:
            MF.remove_files(spark, _STAGED.pop())
        return out
    return run


# the stored translation table is laid out by language pair (C2 prunes folders)
TABLE_PARTITION = ["source_lang", "target_lang"]


def _trn(spark, d):
    return TB.normalise_langs(A.translations(spark, d))


MIX = W(Q.TURNS, Q.SAMPLES, Q.RAW_MIX)
FLAT = W(Q.TURNS, Q.SAMPLES, Q.greedy_ctes(), Q.FLAT_PAIRS)

# -------------------------------------------------------------------- A


@register("a1_parquet_scan", "SELECT conv_id, turn, role, text FROM conversations")
def a1_parquet_scan(spark, d):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    return R.read_parquet(spark, f"{d.rstrip('/')}/conversations.parquet",
                          StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else None).select(
        "conv_id", "turn", "role", "text")


@register("a2_parquet_glob", MIX + "SELECT id, len(messages) AS n_messages, 'parquet' AS ext FROM raw_mix")
@staged
def a2_parquet_glob(spark, d):
    """Shards plus a non-Parquet file in one folder; only *.parquet are read."""
    path = _fresh(spark, "a2")
    A.raw_mix(spark, d).write.parquet(path)
    spark.range(1).select(F.lit("not a shard").alias("value")).write.mode("append").text(path)
    r = R.read_parquet_glob(spark, path, S.RAW_MIX_SCHEMA)
    return r.select("id", C.message_count("messages").alias("n_messages"),
                    F.regexp_extract("file_name", "\\.([a-z]+)$", 1).alias("ext"))


TR_SCHEMA = StructType([StructField("id", LongType()), StructField("source_lang", StringType()),
                        StructField("source_text", StringType()), StructField("target_lang", StringType()),
                        StructField("target_text", StringType())])


@register("a3_csv_scan", W(Q.TR) + "SELECT * FROM tr")
@staged
def a3_csv_scan(spark, d):
    """Multi-line quoted text through CSV (B1 then A3)."""
    path = _fresh(spark, "a3")
    Wr.write_csv(A.translations(spark, d), path, escape_breaks=True)
    return R.read_csv(spark, path, TR_SCHEMA, escaped_breaks=True)


@register("a3_csv_split", W(Q.TR) + "SELECT * FROM tr")
@staged
def a3_csv_split(spark, d):
    """Foreign files with line breaks inside quoted fields, split at record borders."""
    path = _fresh(spark, "a3s")
    Wr.write_csv(A.translations(spark, d), path)
    return R.read_csv(spark, path, TR_SCHEMA, split=True)


def _scraped_documents(spark, d):
    """Documents of at most 100 translations each."""
    item = F.struct(F.col("source_lang"), F.col("source_text").alias("source"), F.col("target_lang"),
                    F.col("target_text").alias("target"))
    return (A.translations(spark, d).groupBy(F.floor(F.col("id") / 100).alias("doc"))
            .agg(F.collect_list(item).alias("translations")).select("translations"))


@register("a4_json_doc", W(Q.TR, Q.TRN) + "SELECT source_lang, source_text, target_lang, target_text FROM trn")
@staged
def a4_json_doc(spark, d):
    """Scraped documents (at most 100 translations each) -> one row per element."""
    path = _fresh(spark, "a4")
    _scraped_documents(spark, d).write.json(path)
    return R.read_scraped(spark, path)


@register("a4_json_doc_split", W(Q.TR, Q.TRN) + "SELECT source_lang, source_text, target_lang, target_text FROM trn")
@staged
def a4_json_doc_split(spark, d):
    """The same documents in the reference's layout (elements found by nesting
    depth, not by line), split inside files."""
    path = _fresh(spark, "a4s")
    _scraped_documents(spark, d).write.json(path)
    return R.read_scraped(spark, path, multiline=True)


@register("a5_json_blocks", FLAT + "SELECT source_lang, source_text, target_lang, target_text FROM flat")
@staged
def a5_json_blocks(spark, d):
    path = _fresh(spark, "a5")
    Wr.write_json_records(P.chat_to_pairs(A.raw_mix(spark, d)).select("pairs", "direction"), path)
    return R.read_blocks(spark, path)


@register("a5_json_blocks_split", FLAT + "SELECT source_lang, source_text, target_lang, target_text FROM flat")
@staged
def a5_json_blocks_split(spark, d):
    """Blocks as JSON arrays (the reference's layout), split inside files."""
    path = _fresh(spark, "a5s")
    blocks = P.chat_to_pairs(A.raw_mix(spark, d)).select(F.to_json(F.struct("pairs", "direction")).alias("b"))
    # arrays of the blocks whose digest begins alike
    arrays = blocks.groupBy(F.substring(F.md5("b"), 1, 2).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("b"), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.text(path)
    return R.read_blocks(spark, path, multiline=True)


def _records(spark, d):
    return CO.training_records(_trn(spark, d))


A6_SQL = W(Q.TR, Q.TRN, REC_SQL, _avail_sql()) + """SELECT CASE WHEN s0 IS NOT NULL AND t0 IS NOT NULL THEN s0 END AS src_lang,
  CASE WHEN s0 IS NOT NULL AND t0 IS NOT NULL THEN t0 END AS tgt_lang FROM dir"""


@register("a6_jsonl_map", A6_SQL)
@staged
def a6_jsonl_map(spark, d):
    """B4 export read back with per-row keys, direction re-derived."""
    path = _fresh(spark, "a6")
    Wr.write_training_jsonl(_records(spark, d), path)
    r = R.read_training_jsonl(spark, path).select(L.infer_direction("translation").alias("dir"))
    return r.select("dir.src_lang", "dir.tgt_lang")


SHEET_CSV_SCHEMA = StructType([StructField("id", LongType()),
                               StructField("Questions ou Affirmations", StringType())])
SHEET_SQL = W(Q.LINES) + """SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS id, line AS "Questions ou Affirmations",
  lang AS langue FROM lines"""


def _sheet(spark, d):
    """Every line of every document, numbered from 1 within its language."""
    from paraspark.operators.ranking import with_row_index
    n = with_row_index(lines(spark, d), ["lang", "doc_id", "pos"], "all_id")
    # one row per language: where its numbers begin; the lines stay where their
    # order has put them and are not dealt by language
    first = n.groupBy("lang").agg(F.min("all_id").alias("first_id")).checkpoint(eager=True)
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    return n.join(first, "lang").select((F.col("all_id") - F.col("first_id") + 1).alias("id"),
                                        F.col("line").alias("Questions ou Affirmations"), F.col("lang").alias("langue"))


@register("a7_required_column", SHEET_SQL)
@staged
def a7_required_column(spark, d):
    path = _fresh(spark, "a7")
    Wr.write_sheet(_sheet(spark, d), path)
    return R.read_sheet(spark, path, SHEET_CSV_SCHEMA, "Questions ou Affirmations").select(
        "id", "Questions ou Affirmations", "langue")


@register("a8_table_scan", W(Q.TR, Q.TRN) + "SELECT * FROM trn")
@staged
def a8_table_scan(spark, d):
    path = _fresh(spark, "a8")
    Wr.bulk_append(_trn(spark, d), path, partition_by=TABLE_PARTITION)
    return R.read_table(spark, "translations_" + path.rsplit("-", 1)[-1], path, TR_SCHEMA, TABLE_PARTITION)


ML_SQL = """SELECT 'run' || CAST(user_id AS VARCHAR) AS run_id, event_type AS metric, epoch_us(ts) // 1000 AS ts_ms, value, event_id AS step
  FROM events"""


@register("a9_metric_log", ML_SQL)
@staged
def a9_metric_log(spark, d):
    path = _fresh(spark, "a9")
    Wr.write_metric_logs(A.metric_log(spark, d), path)
    return R.read_metric_logs(spark, path, run_regex=".*/run_id=([^/]+)/metric=[^/]+/[^/]+$",
                              metric_regex=".*/metric=([^/]+)/[^/]+$")


# -------------------------------------------------------------------- B

@register("b1_csv", MIX + "SELECT dataset, id, CAST(to_json(messages) AS VARCHAR) AS messages, direction FROM raw_mix")
@staged
def b1_csv(spark, d):
    """Nested messages through CSV as JSON text and back."""
    path = _fresh(spark, "b1")
    Wr.write_csv(A.raw_mix(spark, d), path)
    r = R.read_csv(spark, path, S.RAW_MIX_CSV_SCHEMA)
    return r.select("dataset", "id", "messages", "direction")


PPS = W(Q.TURNS, Q.SAMPLES, Q.greedy_ctes()) + f"""SELECT s.id, count(g.pos) AS n_pairs
  FROM samples s LEFT JOIN greedy g USING (conv_id) WHERE {Q.in_list('s.direction', S.KEPT_DIRECTIONS)} GROUP BY s.id"""
PPS_FLAG = f"SELECT p.id, s.direction, p.n_pairs, p.n_pairs = 0 AS problem FROM ({PPS}) p JOIN ({W(Q.TURNS, Q.SAMPLES)} SELECT * FROM samples) s USING (id)"
# valid conversations only: those with pairs
PAIRS_FULL = W(Q.TURNS, Q.SAMPLES, Q.greedy_ctes()) + f"""SELECT s.id, s.direction, g.pos, g.texte_cible, g.traduction
  FROM samples s JOIN greedy g USING (conv_id) WHERE {Q.in_list('s.direction', S.KEPT_DIRECTIONS)}"""


@register("b2_json_records", PAIRS_FULL)
@staged
def b2_json_records(spark, d):
    path = _fresh(spark, "b2")
    Wr.write_json_records(P.chat_to_pairs(A.raw_mix(spark, d)).select("id", "direction", "pairs", "problem"), path, flag="problem")
    r = spark.read.schema("id STRING, direction STRING, pairs ARRAY<STRUCT<texte_cible: STRING, traduction: STRING>>").json(path)
    return r.select("id", "direction", F.posexplode("pairs").alias("pos", "p")).select(
        "id", "direction", F.col("pos").cast("long").alias("pos"), "p.texte_cible", "p.traduction")


@register("b3_quarantine", PPS_FLAG)
@staged
def b3_quarantine(spark, d):
    path = _fresh(spark, "b3")
    Wr.write_quarantine(P.chat_to_pairs(A.raw_mix(spark, d)), path)
    r = spark.read.schema("id STRING, direction STRING, pairs ARRAY<STRUCT<texte_cible: STRING, traduction: STRING>>, problem BOOLEAN").json(path)
    return r.select("id", "direction", C.pair_count("pairs").alias("n_pairs"), "problem")


@register("b4_jsonl_export", W(Q.TR, Q.TRN, REC_SQL) + "SELECT k, v FROM rec_long")
@staged
def b4_jsonl_export(spark, d):
    path = _fresh(spark, "b4")
    Wr.write_training_jsonl(_records(spark, d), path)
    r = spark.read.text(path).select(F.from_json("value", "translation MAP<STRING, STRING>").alias("j"))
    return r.select(F.explode("j.translation").alias("k", "v"))


B5_SQL = W(Q.TR, Q.TRN) + f"""SELECT * FROM trn WHERE source_lang IN ('fr', 'en', 'dr') AND target_lang IN ('fr', 'en', 'dr')
  AND length(source_text) BETWEEN 1 AND 500 AND length(target_text) BETWEEN 1 AND 500 AND source_lang <> target_lang"""


@register("b5_bulk_append", B5_SQL)
@staged
def b5_bulk_append(spark, d):
    """Validated rows (J1) loaded into a table folder, all at once, then scanned."""
    path = _fresh(spark, "b5")
    valid, _ = TB.split_valid(_trn(spark, d))
    LD.bulk_load(valid, path, TABLE_PARTITION)
    return LD.read_loads(spark, path, TR_SCHEMA, TABLE_PARTITION)


@register("b6_append_pairs", W(Q.TR, Q.TRN, Q.TURNS, Q.SAMPLES, Q.greedy_ctes(), Q.FLAT_PAIRS) + f"""SELECT source_lang, source_text, target_lang,
  CASE WHEN coalesce(target_text, '') = '' THEN {Q.q(S.MISSING_TARGET)} ELSE target_text END AS target_text FROM (
  SELECT source_lang, source_text, target_lang, target_text FROM trn
  UNION ALL SELECT source_lang, source_text, target_lang, target_text FROM flat)""")
@staged
def b6_append_pairs(spark, d):
    """Two appends (scraped rows, then extracted pairs) to one JSON store; a
    missing target is written as the sentinel (C8)."""
    path = _fresh(spark, "b6")
    for part in (_trn(spark, d), P.flat_pairs_long(A.sample_turns(spark, d))):
        Wr.append_records(part.select("source_lang", "source_text", "target_lang",
                                      TB.missing_target_default("target_text").alias("target_text")), path)
    return spark.read.schema("source_lang STRING, source_text STRING, target_lang STRING, target_text STRING").json(path)


@register("b7_sheet", SHEET_SQL)
@staged
def b7_sheet(spark, d):
    path = _fresh(spark, "b7")
    Wr.write_sheet(_sheet(spark, d), path)
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema("id BIGINT, `Questions ou Affirmations` STRING, langue STRING").csv(path))


@register("b8_profile_json", MIX + """SELECT d.direction, d.count, t.rows FROM
  (SELECT direction, count(*) AS count FROM raw_mix GROUP BY direction) d, (SELECT count(*) AS rows FROM raw_mix) t""")
@staged
def b8_profile_json(spark, d):
    """A nested one-row profile (total + per-direction counts) as JSON and back."""
    path = _fresh(spark, "b8")
    per_dir = PR.count_by(A.samples(spark, d), "direction")
    # at most one entry per distinct direction: a bounded list
    prof = per_dir.agg(F.sum("count").alias("rows"), F.collect_list(F.struct("direction", "count")).alias("directions"))
    Wr.write_profile_json(prof, path)
    back = spark.read.schema("rows BIGINT, directions ARRAY<STRUCT<direction: STRING, count: BIGINT>>").json(path)
    return back.select("rows", F.explode("directions").alias("x")).select("x.direction", "x.count", "rows")


# -------------------------------------------------------------------- L

def _clean_rows(df):
    """Per-row stage of the incremental ingest: C10 + D5 on both texts."""
    return df.select(L.normalize_lang("source_lang").alias("source_lang"),
                     T.clean_text("source_text").alias("source_text"),
                     L.normalize_lang("target_lang").alias("target_lang"),
                     T.clean_text("target_text").alias("target_text"))


L_SQL = W(Q.TR) + f"""SELECT DISTINCT {Q.normalize_lang('source_lang')} AS source_lang, {Q.clean('source_text')} AS source_text,
  {Q.normalize_lang('target_lang')} AS target_lang, {Q.clean('target_text')} AS target_text FROM tr"""

PAIR_SCHEMA = StructType([StructField(c, StringType()) for c in FIELDS])


def _arrive(spark, d, staging: str) -> None:
    A.translations(spark, d).write.mode("append").option("compression", "zstd").parquet(staging)


@register("l1_stream_ingest", L_SQL)
@staged
def l1_stream_ingest(spark, d):
    """The table arrives, is ingested, then arrives again (a replayed
    delivery): the second run adds nothing."""
    base = _fresh(spark, "l1")
    staging, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    for _ in range(2):
        _arrive(spark, d, staging)
        ST.ingest_dedup(spark, staging, TR_SCHEMA, _clean_rows, FIELDS, sink, ckpt, PAIR_SCHEMA)
    return ST.read_target(spark, sink, PAIR_SCHEMA)


@register("l2_foreach_batch", L_SQL)
@staged
def l2_foreach_batch(spark, d):
    base = _fresh(spark, "l2")
    staging, target, ckpt = f"{base}/in", f"{base}/table", f"{base}/ckpt"
    for _ in range(2):
        _arrive(spark, d, staging)
        ST.ingest_anti_join(spark, staging, TR_SCHEMA, _clean_rows, FIELDS, target, ckpt, PAIR_SCHEMA)
    return ST.read_target(spark, target, PAIR_SCHEMA)
