"""Registered queries: C (projections/filters) and D (scalar text functions)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.functions import lang as L
from paraspark.functions import text as T
from paraspark.operators import search as SE
from paraspark.operators import table as TB
from paraspark.plans import adapters as A
from paraspark.plans import pipelines as P
from paraspark.plans import sqltext as Q
from paraspark.plans.registry import register
from paraspark.session import remove_folder, shared_path

W = Q.with_


def _turns(spark, d):
    return A.turns(spark, d)


def _trn(spark, d):
    return TB.normalise_langs(A.translations(spark, d))


def lines(spark, d):
    """Documents -> (doc_id, lang, pos, line), blanks dropped."""
    docs = A.texts(spark, d, "documents")
    return (docs.select("doc_id", "lang", F.posexplode(F.split(T.strip_ws("text"), "\n")).alias("pos", "raw"))
            .select("doc_id", "lang", F.col("pos").cast("long").alias("pos"), T.strip_ws("raw").alias("line"))
            .filter(F.col("line") != ""))


# ------------------------------------------------------------------ D group

def _turn_query(fn):
    def q(spark, d):
        return _turns(spark, d).select("conv_id", "turn", fn(F.col("content")).alias("out"))
    return q


def _turn_sql(expr: str) -> str:
    return W(Q.TURNS) + f"SELECT conv_id, turn, {expr.replace('{x}', 'content')} AS out FROM turns"


register("d1_prefix", _turn_sql(f"regexp_replace({{x}}, {Q.q(Q.PREFIX_RE2)}, '', 'g')"))(_turn_query(T.strip_prefix))
register("d2_spaces", _turn_sql(
    f"replace(replace(replace({{x}}, {Q.q(chr(92) + 'xa0')}, ' '), chr(160), ' '), chr(8201), ' ')"))(
    _turn_query(T.normalise_spaces))
register("d3_backslashes", _turn_sql(
    f"replace(replace({{x}}, {Q.q(chr(92) + chr(39))}, {Q.q(chr(39))}), {Q.q(chr(92))}, ' ')"))(
    _turn_query(T.unescape_backslashes))
register("d4_trim", _turn_sql(Q.strip_ws("{x}")))(_turn_query(T.strip_ws))
register("d5_clean_text", _turn_sql(Q.clean("{x}")))(_turn_query(T.clean_text))
D8_SQL = ("CASE WHEN contains({x}, " + Q.q(S.FULL_PREFIX) + ") THEN "
          + Q.strip_ws("replace({x}, " + Q.q(S.FULL_PREFIX) + ", '')") + " ELSE {x} END")
register("d8_full_prefix", _turn_sql(D8_SQL))(_turn_query(T.strip_full_prefix))
register("d9_length", _turn_sql("length({x})"))(_turn_query(T.char_length))
register("d11_has_script", _turn_sql(f"regexp_matches({{x}}, {Q.q(S.ARABIC_CLASS)})"))(_turn_query(T.has_script))


@register("d6_newlines", W(Q.TURNS) + f"SELECT conv_id, turn, {Q.drop_nl(Q.py_repr('content'), 'row_repr')} AS out FROM turns")
def d6_newlines(spark, d):
    """D6 on repr-escaped text (literal \\n removed, words fuse)."""
    t = _turns(spark, d)
    return t.select("conv_id", "turn", T.drop_newlines(A._py_repr(F.col("content")), T.ROW_REPR).alias("out"))


@register("d7_markers", W(Q.TURNS, Q.MARKED) + f"SELECT conv_id, mpos, {Q.drop_markers('content')} AS out FROM marked_msgs")
def d7_markers(spark, d):
    return A.marked_turns(spark, d).select("conv_id", F.col("turn").alias("mpos"), T.drop_markers("content").alias("out"))


D10_SQL_STARTS = " OR ".join(f"starts_with(lower(line), {Q.q(w)})" for w in S.INTERROGATIVES)
D10_SQL_INSIDE = " OR ".join(f"contains(lower(line), {Q.q(' ' + w + ' ')})" for w in S.INTERROGATIVES)


@register("d10_classify", W(Q.LINES) + f"""SELECT doc_id, pos, CASE WHEN contains(line, '?') OR {D10_SQL_STARTS} OR {D10_SQL_INSIDE}
  THEN {Q.q(S.QUESTION)} ELSE {Q.q(S.STATEMENT)} END AS kind FROM lines""")
def d10_classify(spark, d):
    return lines(spark, d).select("doc_id", "pos", T.classify_question("line").alias("kind"))


@register("d12_lines", W(Q.LINES) + "SELECT doc_id, pos, line FROM lines")
def d12_lines(spark, d):
    return lines(spark, d).select("doc_id", "pos", "line")


@register("d13_mean_round", W(Q.TURNS) + "SELECT role, round(avg(length(content)), 2) AS mean_len FROM turns GROUP BY role")
def d13_mean_round(spark, d):
    return _turns(spark, d).groupBy("role").agg(T.mean_round(F.length("content"), 2).alias("mean_len"))


# ------------------------------------------------------------------ C group

@register("c1_direction_filter", W(Q.TURNS, Q.SAMPLES) + f"SELECT id, direction FROM samples WHERE {Q.in_list('direction', S.KEPT_DIRECTIONS)}")
def c1_direction_filter(spark, d):
    return P.keep_directions(A.samples(spark, d)).select("id", "direction")


@register("c2_lang_filter", W(Q.TR, Q.TRN) + "SELECT id, source_lang, target_lang FROM trn WHERE source_lang = 'dr'")
def c2_lang_filter(spark, d):
    """Only the source language is given; the target adds no predicate."""
    return TB.filter_langs(_trn(spark, d), source_lang="dr", target_lang=None).select("id", "source_lang", "target_lang")


@register("c3_get_by_id", W(Q.TR, Q.TRN) + "SELECT * FROM trn WHERE id = 7")
def c3_get_by_id(spark, d):
    return TB.get_by_id(_trn(spark, d), 7)


C4_PREFIX = "Th"


@register("c4_prefix_delete", W(Q.TR) + f"""SELECT id FROM tr
  WHERE NOT coalesce(starts_with(source_text, {Q.q(C4_PREFIX)}) OR starts_with(target_text, {Q.q(C4_PREFIX)}), false)""")
def c4_prefix_delete(spark, d):
    return TB.delete_prefixed(A.translations(spark, d), C4_PREFIX).select("id")


@register("c4_prefix_delete_count", W(Q.TR) + f"""SELECT count(*) AS removed FROM tr
  WHERE coalesce(starts_with(source_text, {Q.q(C4_PREFIX)}) OR starts_with(target_text, {Q.q(C4_PREFIX)}), false)""")
def c4_prefix_delete_count(spark, d):
    return A.translations(spark, d).filter(TB.starts_with_prefix(C4_PREFIX)).agg(F.count(F.lit(1)).alias("removed"))


@register("c5_canonical", W(Q.TR) + "SELECT id, source_lang, source_text, target_lang, target_text FROM tr")
def c5_canonical(spark, d):
    """Scraped item shape (source/target) renamed to the canonical columns."""
    t = A.translations(spark, d)
    items = t.select("id", F.struct(F.col("source_lang"), F.col("source_text").alias("source"),
                                    F.col("target_lang"), F.col("target_text").alias("target")).alias("t"))
    return items.select("id", F.col("t.source_lang").alias("source_lang"), F.col("t.source").alias("source_text"),
                        F.col("t.target_lang").alias("target_lang"), F.col("t.target").alias("target_text"))


@register("c6_exportable", W(Q.TR, Q.TRN) + f"SELECT id FROM trn WHERE {Q.exportable()}")
def c6_exportable(spark, d):
    return P.exportable(_trn(spark, d)).select("id")


@register("c8_sentinel", f"""SELECT u.conv_id, u.turn,
  CASE WHEN coalesce(a.text, '') = '' THEN {Q.q(S.MISSING_TARGET)} ELSE a.text END AS target
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'""")
def c8_sentinel(spark, d):
    c = A.table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn")
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return u.join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", TB.missing_target_default("text").alias("target"))


@register("c9_split_direction", W(Q.TURNS, Q.SAMPLES) + """SELECT id, split_part(direction, '_', 1) AS src, split_part(direction, '_', 2) AS tgt FROM samples""")
def c9_split_direction(spark, d):
    r = A.samples(spark, d).select("id", L.split_direction("direction").alias("p"))
    return r.select("id", F.col("p")[0].alias("src"), F.col("p")[1].alias("tgt"))


@register("c10_normalize_lang", W(Q.TR, Q.TRN) + "SELECT id, source_lang, target_lang FROM trn")
def c10_normalize_lang(spark, d):
    return _trn(spark, d).select("id", "source_lang", "target_lang")


@register("c11_model_code", W(Q.TR, Q.TRN) + f"SELECT id, {Q.model_code('source_lang')} AS src_code, {Q.model_code('target_lang')} AS tgt_code FROM trn")
def c11_model_code(spark, d):
    return _trn(spark, d).select("id", L.model_code("source_lang").alias("src_code"),
                                 L.model_code("target_lang").alias("tgt_code"))


@register("c12_first_n", W(Q.TR, Q.TRN) + "SELECT * FROM trn ORDER BY id LIMIT 10")
def c12_first_n(spark, d):
    return TB.first_n(_trn(spark, d), 10, ["id"])


@register("c13_non_blank", f"""SELECT doc_id, pos - 1 AS pos, {Q.strip_ws('raw')} AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE {Q.strip_ws('raw')} <> ''""")
def c13_non_blank(spark, d):
    docs = A.texts(spark, d, "documents")
    x = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return x.filter(T.non_blank("raw")).select("doc_id", F.col("pos").cast("long").alias("pos"),
                                               T.strip_ws("raw").alias("line"))


C14_SQL = W(Q.TR, Q.TRN) + """SELECT id FROM trn
  WHERE coalesce(contains(lower(source_text), 'the') OR contains(lower(target_text), 'the'), false) AND source_lang = 'en'"""


@register("c14_text_search", C14_SQL)
def c14_text_search(spark, d):
    return TB.text_search(_trn(spark, d), "The", source_lang="en").select("id")


@register("c14_text_search_indexed", C14_SQL)
def c14_text_search_indexed(spark, d):
    """The same search by a trigram index built for it."""
    path = shared_path(spark, f"trigrams-{uuid.uuid4().hex[:12]}")
    rows = _trn(spark, d)
    SE.write_index(rows, path)
    out = SE.text_search_indexed(rows, SE.read_index(spark, path), "The", source_lang="en").select("id").checkpoint(eager=True)
    remove_folder(spark, path)
    return out
