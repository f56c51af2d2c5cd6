"""Registered queries: C7 (both languages present), E18 (dataset card
flattening) and G2 (dimension lookup)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.operators import corpus as CO
from paraspark.operators import profile as PR
from paraspark.operators import table as TB
from paraspark.plans import adapters as A
from paraspark.plans import sqltext as Q
from paraspark.plans.queries_chat import REC_SQL
from paraspark.plans.registry import register

W = Q.with_


@register("c7_both_langs", W(Q.TR, Q.TRN, REC_SQL) + f"""SELECT id FROM rec_long WHERE v IS NOT NULL
  GROUP BY id HAVING count(*) FILTER (WHERE k = {Q.q(S.TRAIN_SOURCE_LANG)}) > 0 AND count(*) FILTER (WHERE k = {Q.q(S.TRAIN_TARGET_LANG)}) > 0""")
def c7_both_langs(spark, d):
    """Training records that hold both the source and the target language."""
    r = CO.training_records(TB.normalise_langs(A.translations(spark, d)))
    m = F.col("translation")
    return r.filter(F.try_element_at(m, F.lit(S.TRAIN_SOURCE_LANG)).isNotNull()
                    & F.try_element_at(m, F.lit(S.TRAIN_TARGET_LANG)).isNotNull()).select("id")


def _lang_dim(spark):
    """The fixed code table as a dimension (three rows: a proven size bound)."""
    return spark.createDataFrame(sorted(S.MODEL_LANG_CODE.items()), "code STRING, model_code STRING")


DIM_SQL = "dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({Q.q(k)}, {Q.q(v)})" for k, v in sorted(S.MODEL_LANG_CODE.items())) + ") t(code, model_code))"


@register("g2_dimension_lookup", W(Q.TR, Q.TRN, DIM_SQL) + """SELECT t.id, t.source_lang, d.model_code AS src_model, t.target_lang, e.model_code AS tgt_model
  FROM trn t LEFT JOIN dim d ON d.code = t.source_lang JOIN dim e ON e.code = t.target_lang""")
def g2_dimension_lookup(spark, d):
    """Source code looked up with pass-through on a miss (left join), target
    code with drop on a miss (inner join); the dimension is broadcast."""
    t = TB.normalise_langs(A.translations(spark, d))
    dim = F.broadcast(_lang_dim(spark))
    src = dim.select(F.col("code").alias("source_lang"), F.col("model_code").alias("src_model"))
    tgt = dim.select(F.col("code").alias("target_lang"), F.col("model_code").alias("tgt_model"))
    return (t.join(src, "source_lang", "left").join(tgt, "target_lang", "inner")
            .select("id", "source_lang", "src_model", "target_lang", "tgt_model"))


def _cards(spark, d):
    """One dataset card (JSON text) per document source: downloads = rows,
    tags = languages, one file per language; even-numbered sources omit
    ``likes`` and ``gated`` so the defaults apply."""
    docs = A.table(spark, d, "documents")
    g = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"),
                                   F.sort_array(F.collect_set("lang")).alias("langs"))
    # a source without a trailing number counts as odd (no ANSI cast error)
    even = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % 2 == 0, F.lit(False))
    card = F.struct(
        F.col("source").alias("id"), F.lit("driver").alias("author"), F.col("rows").alias("downloads"),
        F.when(~even, F.size("langs").cast("long")).alias("likes"),
        F.when(~even, F.lit(True)).alias("gated"),
        F.col("langs").alias("tags"),
        F.when(~even, F.concat(F.lit("about "), F.col("source"))).alias("description"),
        F.when(~even, F.lit(True)).alias("disabled"),
        F.lit("2024-01-02").alias("lastModified"),
        F.when(~even, F.struct(F.lit("cc-by-4.0").alias("license"), F.array(F.lit("bleu")).alias("metrics"),
                               F.array(F.lit("translation")).alias("task_categories"),
                               F.array(PR.size_category("rows")).alias("size_categories"))).alias("cardData"),
        F.transform("langs", lambda x: F.struct(F.concat(F.lit("raw/"), x).alias("rfilename"))).alias("siblings"),
        F.create_map(F.lit("data"), F.create_map(F.lit("parquet"), F.transform(
            "langs", lambda x: F.concat(x, F.lit(".parquet"))))).alias("files"))
    # to_json drops null fields, so the even cards really lack those keys
    return g.select("source", F.to_json(card).alias("card"))


_CARD_ODD = "NOT coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 2 = 0, false)"


@register("e18_card", f"""SELECT source AS nom, 'driver' AS auteur, CASE WHEN odd THEN 'about ' || source ELSE '' END AS description,
  CASE WHEN odd THEN 'cc-by-4.0' END AS licence, '2024-01-02' AS mis_a_jour, odd AS acces_restreint, odd AS desactive,
  rows AS telechargements, CASE WHEN odd THEN len(langs) ELSE 0 END AS likes, array_to_string(langs, ',') AS tags,
  CASE WHEN odd THEN 'bleu' ELSE '' END AS metriques, CASE WHEN odd THEN 'translation' ELSE '' END AS taches,
  CASE WHEN NOT odd THEN '' WHEN rows < 1000 THEN 'n<1K' WHEN rows < 10000 THEN '1K<n<10K' WHEN rows < 100000 THEN '10K<n<100K'
    WHEN rows < 1000000 THEN '100K<n<1M' ELSE 'more' END AS taille, 'Parquet' AS format, len(langs) AS fichiers_nombre,
  'data/parquet:' || array_to_string(list_transform(langs, lambda x: x || '.parquet'), ',') AS fichiers_liste,
  array_to_string(list_transform(langs, lambda x: 'raw/' || x), ',') AS fichiers_raw
  FROM (SELECT source, count(*) AS rows, list(DISTINCT lang ORDER BY lang) FILTER (WHERE lang IS NOT NULL) AS langs, {_CARD_ODD} AS odd
        FROM documents GROUP BY source)""")
def e18_card(spark, d):
    """Every field of the flattened card; lists as comma-separated text."""
    p = _cards(spark, d).select(PR.flatten_card("card").alias("p")).select("p.*")
    lists = ("tags", "metriques", "taches", "taille")
    files = F.transform(F.map_entries("fichiers_liste"), lambda e: F.array_join(F.transform(
        F.map_entries(e["value"]), lambda k: F.concat(e["key"], F.lit("/"), k["key"], F.lit(":"), F.array_join(k["value"], ","))), ";"))
    return (p.withColumns({c: F.array_join(c, ",") for c in lists})
            .withColumn("fichiers_liste", F.array_join(files, ";"))
            .withColumn("fichiers_raw", F.array_join(F.transform("fichiers_raw", lambda x: x["rfilename"]), ","))
            .withColumn("fichiers_nombre", F.col("fichiers_nombre").cast("long")))
