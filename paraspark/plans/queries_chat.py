"""Registered queries: E (array / struct / map / JSON functions over chat data)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.functions import chat as C
from paraspark.functions import html as H
from paraspark.functions import lang as L
from paraspark.functions import text as T
from paraspark.operators import corpus as CO
from paraspark.operators import dialogue as D
from paraspark.operators import pairing as PR
from paraspark.operators import score as SC
from paraspark.operators import table as TB
from paraspark.plans import adapters as A
from paraspark.plans import pipelines as P
from paraspark.plans import sqltext as Q
from paraspark.plans.registry import register

W = Q.with_
WS = Q.WS_SQL


def _conv_id(id_col="id"):
    return F.col(id_col).cast("long").alias("conv_id")


def _flat(df, pairs="pairs"):
    x = df.select(_conv_id(), F.posexplode_outer(pairs).alias("pos", "p")).filter(F.col("pos").isNotNull())
    return x.select("conv_id", F.col("pos").cast("long").alias("pos"),
                    F.col("p.texte_cible").alias("texte_cible"), F.col("p.traduction").alias("traduction"))


# ---------------------------------------------------------------- E1 parse

ROW_RE2 = ("(?s)Row\\(content='(.*?)'," + S.WS_CLASS + "*role=['\"](.*?)['\"]\\)|Row\\(content=\"(.*?)\","
           + S.WS_CLASS + "*role=['\"](.*?)['\"]\\)")

REPR_SQL = f"""rendered AS (
  SELECT conv_id,
         '[' || string_agg('Row(content=' || {Q.py_repr('content')} || ', role=' || {Q.py_repr('role')} || ')', ', ' ORDER BY turn) || ']' AS s
  FROM turns GROUP BY conv_id),
parsed AS (
  SELECT conv_id,
         list_transform(regexp_extract_all(s, {Q.q(ROW_RE2)}, 1), lambda x, i: coalesce(x, regexp_extract_all(s, {Q.q(ROW_RE2)}, 3)[i])) AS contents,
         list_transform(regexp_extract_all(s, {Q.q(ROW_RE2)}, 2), lambda x, i: coalesce(x, regexp_extract_all(s, {Q.q(ROW_RE2)}, 4)[i])) AS roles
  FROM rendered)"""


@register("e1_row_repr", W(Q.TURNS, REPR_SQL) + """SELECT conv_id, pos - 1 AS pos, content, role FROM (
  SELECT conv_id, unnest(contents) AS content, unnest(roles) AS role, generate_subscripts(contents, 1) AS pos FROM parsed)""")
def e1_row_repr(spark, d):
    r = A.raw_mix_repr(spark, d).select("id", C.parse_row_repr("messages").alias("m"))
    x = r.select(_conv_id(), F.posexplode("m").alias("pos", "msg"))
    return x.select("conv_id", F.col("pos").cast("long").alias("pos"),
                    F.col("msg.content").alias("content"), F.col("msg.role").alias("role"))


# ------------------------------------------------------ E2..E6 marked input

def _side(x: str) -> str:
    return Q.clean(Q.drop_markers(Q.drop_nl(x)))


def _count(x: str, marker: str) -> str:
    return f"((length({x}) - length(replace({x}, {Q.q(marker)}, ''))) // {len(marker)})"


MARKED_PAIRS = f"""mm AS (SELECT conv_id, mpos AS turn, content, role FROM marked_msgs),
mk AS (
  SELECT conv_id, content AS first_content,
         coalesce(role = 'user' AND (contains(content, {Q.q(S.ASSISTANT_MARK)}) OR contains(content, {Q.q(S.USER_MARK)})), false) AS mk
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM mm) WHERE rn = 1),
ext AS (
  SELECT conv_id, coalesce({Q.clean(Q.strip_ws('content'))}, '') AS ext FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM mm WHERE role = 'assistant')
  WHERE rn = 1),
cnt AS (
  SELECT conv_id, (sum({_count('content', S.USER_MARK)}) + 1 - sum({_count('content', S.ASSISTANT_MARK)})) = 1 AS unmatched,
         arg_min(content, turn) AS fb_raw
  FROM mm GROUP BY conv_id),
e2_lists AS (
  SELECT conv_id,
         list_transform(list_filter(list_transform(string_split(first_content, {Q.q(S.USER_MARK)}), lambda x: {Q.strip_ws('x')}), lambda x: x <> ''),
           lambda sg: struct_pack(
             texte_cible := {_side(Q.strip_ws(f"string_split(sg, {Q.q(S.ASSISTANT_MARK)})[1]"))},
             traduction := {_side(f"coalesce({Q.strip_ws(f'string_split(sg, {Q.q(S.ASSISTANT_MARK)})[2]')}, '')")})) AS pl
  FROM mk WHERE mk),
e2_long AS (
  SELECT conv_id, generate_subscripts(pl, 1) - 1 AS pos, unnest(pl) AS p, len(pl) AS n FROM e2_lists),
e2_filled AS (
  SELECT l.conv_id, l.pos, l.n, l.p.texte_cible AS texte_cible,
         CASE WHEN l.pos = l.n - 1 AND l.p.traduction = '' AND coalesce(e.ext, '') <> '' THEN e.ext ELSE l.p.traduction END AS traduction
  FROM e2_long l LEFT JOIN ext e USING (conv_id)),
gsrc AS (SELECT mm.* FROM mm JOIN mk USING (conv_id) WHERE NOT mk.mk),
{Q.greedy_ctes('gsrc', name='gm')},
gm_n AS (SELECT conv_id, pos, texte_cible, traduction, count(*) OVER (PARTITION BY conv_id) AS n FROM gm),
dispatched AS (
  SELECT conv_id, pos, n, texte_cible, traduction FROM e2_filled
  UNION ALL SELECT conv_id, pos, n, texte_cible, traduction FROM gm_n)"""


@register("e2_split_marked", W(Q.TURNS, Q.MARKED, MARKED_PAIRS) + "SELECT conv_id, pos, p.texte_cible AS texte_cible, p.traduction AS traduction FROM e2_long")
def e2_split_marked(spark, d):
    first = D.marked_openings(A.marked_turns(spark, d), ["id"])
    return _flat(first.select("id", C.split_marked("content", T.NATIVE).alias("pairs")))


@register("e3_greedy_pairs", W(Q.TURNS, Q.greedy_ctes()) + "SELECT conv_id, pos, texte_cible, traduction FROM greedy")
def e3_greedy_pairs(spark, d):
    r = A.raw_mix(spark, d).select("id", C.clean_messages("messages", T.NATIVE).alias("cm"))
    return _flat(r.select("id", C.greedy_pairs("cm").alias("pairs")))


@register("e3_greedy_pairs_long", W(Q.TURNS, Q.greedy_ctes()) + "SELECT conv_id, pos, texte_cible, traduction FROM greedy")
def e3_greedy_pairs_long(spark, d):
    """E3 over turn-per-row data (window form), same pairs as the array fold."""
    t = A.turns(spark, d).select("conv_id", "turn", "role",
                                 T.clean_text(T.drop_newlines(F.col("content"), T.NATIVE)).alias("content"))
    return PR.greedy_pairs_long(t, ["conv_id"])


def _dispatch_sql(with_fallback: bool) -> str:
    fb = f"{Q.clean('coalesce(c.fb_raw, ' + chr(39) + chr(39) + ')')}" if with_fallback else "''"
    return W(Q.TURNS, Q.MARKED, MARKED_PAIRS, Q.SAMPLES) + f"""SELECT s.id, x.pos,
  x.texte_cible,
  CASE WHEN x.pos = x.n - 1 AND x.traduction = '' AND c.unmatched THEN {fb} ELSE x.traduction END AS traduction
FROM dispatched x JOIN cnt c USING (conv_id) JOIN samples s USING (conv_id)
WHERE {Q.in_list('s.direction', S.KEPT_DIRECTIONS)}"""


def _dispatch(spark, d, fallback: bool):
    m = P.keep_directions(A.marked_turns(spark, d))
    p = D.dispatch_long(m, ["id"], fallback=D.opening_content() if fallback else None)
    return p.select("id", "pos", "texte_cible", "traduction")


@register("e4_dispatch", _dispatch_sql(False))
def e4_dispatch(spark, d):
    """E4 + E5 on mixed input (marked first message or plain turns)."""
    return _dispatch(spark, d, False)


@register("e5_fill_last", W(Q.TURNS, Q.MARKED, MARKED_PAIRS) + """SELECT conv_id, texte_cible, traduction
  FROM e2_filled WHERE pos = n - 1""")
def e5_fill_last(spark, d):
    """Last pair of every marked sample after completion from the outside assistant."""
    p = D.dispatch_long(A.marked_turns(spark, d), ["conv_id"])
    return p.filter(F.col("marked") & (F.col("pos") == F.col("n_pairs") - 1)).select("conv_id", "texte_cible", "traduction")


@register("e6_unmatched", _dispatch_sql(True))
def e6_unmatched(spark, d):
    """E4-E6 with a fallback column (the cleaned first message)."""
    return _dispatch(spark, d, True)


@register("e7_flatten", W(Q.TURNS, Q.SAMPLES, Q.greedy_ctes(), Q.FLAT_PAIRS) + "SELECT * FROM flat")
def e7_flatten(spark, d):
    return P.flat_pairs_long(A.sample_turns(spark, d))


PAIRS_PER_SAMPLE = f"""pps AS (
  SELECT s.id, count(g.pos) AS n_pairs
  FROM samples s LEFT JOIN greedy g USING (conv_id)
  WHERE {Q.in_list('s.direction', S.KEPT_DIRECTIONS)}
  GROUP BY s.id)"""


@register("e8_quarantine_flag", W(Q.TURNS, Q.SAMPLES, Q.greedy_ctes(), PAIRS_PER_SAMPLE) + "SELECT id, n_pairs = 0 AS problem FROM pps")
def e8_quarantine_flag(spark, d):
    return D.pair_counts_long(P.keep_directions(A.sample_turns(spark, d)), ["id"]).select("id", "problem")


@register("e9_pair_count", W(Q.TURNS, Q.SAMPLES, Q.greedy_ctes(), PAIRS_PER_SAMPLE) + "SELECT id, n_pairs FROM pps")
def e9_pair_count(spark, d):
    return D.pair_counts_long(P.keep_directions(A.sample_turns(spark, d)), ["id"]).select("id", "n_pairs")


@register("e10_messages_json", W(Q.TURNS, Q.SAMPLES, Q.RAW_MIX) + "SELECT id, md5(CAST(to_json(messages) AS VARCHAR)) AS json_md5, length(CAST(to_json(messages) AS VARCHAR)) AS json_len FROM raw_mix")
def e10_messages_json(spark, d):
    return A.raw_mix(spark, d).select(
        "id", F.md5(C.messages_json("messages")).alias("json_md5"), F.length(C.messages_json("messages")).cast("long").alias("json_len"))


@register("e11_message_count", W(Q.TURNS, Q.SAMPLES, Q.RAW_MIX) + """SELECT id, len(messages) AS n_native,
  coalesce(json_array_length(to_json(messages)), 0) AS n_json FROM raw_mix""")
def e11_message_count(spark, d):
    t = A.sample_turns(spark, d)
    native = D.message_metrics(t, ["id"]).select("id", F.col("n_messages").alias("n_native"))
    return native.join(D.json_message_counts(t, ["id"]).withColumnRenamed("n_messages", "n_json"), "id")


def _records(spark, d):
    return CO.training_records(TB.normalise_langs(A.translations(spark, d)))


REC_SQL = f"""rec AS (
  SELECT id, {Q.model_code('source_lang')} AS ks, source_text AS vs, {Q.model_code('target_lang')} AS kt, target_text AS vt
  FROM trn WHERE {Q.exportable()}),
rec_long AS (
  SELECT id, kt AS k, vt AS v FROM rec
  UNION ALL SELECT id, ks AS k, vs AS v FROM rec WHERE ks <> kt)"""


@register("e14_translation_map", W(Q.TR, Q.TRN, REC_SQL) + "SELECT id, k, v FROM rec_long")
def e14_translation_map(spark, d):
    return _records(spark, d).select("id", F.explode("translation").alias("k", "v"))


def _avail_sql() -> str:
    src, tgt = S.TRAIN_SOURCE_LANG, S.TRAIN_TARGET_LANG
    return f"""avail AS (SELECT id, list(DISTINCT k ORDER BY k) AS langs FROM rec_long WHERE v IS NOT NULL GROUP BY id),
dir AS (
  SELECT id,
    CASE WHEN list_contains(langs, {Q.q(src)}) AND list_contains(langs, {Q.q(tgt)}) THEN {Q.q(src)}
         WHEN list_contains(langs, {Q.q(tgt)}) THEN list_filter(langs, lambda k: k <> {Q.q(tgt)})[1]
         WHEN list_contains(langs, {Q.q(src)}) THEN {Q.q(src)}
         ELSE langs[1] END AS s0,
    CASE WHEN list_contains(langs, {Q.q(src)}) AND list_contains(langs, {Q.q(tgt)}) THEN {Q.q(tgt)}
         WHEN list_contains(langs, {Q.q(tgt)}) THEN {Q.q(tgt)}
         WHEN list_contains(langs, {Q.q(src)}) THEN list_filter(langs, lambda k: k <> {Q.q(src)})[1]
         ELSE langs[2] END AS t0
  FROM avail)"""


@register("e12_infer_direction", W(Q.TR, Q.TRN, REC_SQL, _avail_sql()) + """SELECT id,
  CASE WHEN s0 IS NOT NULL AND t0 IS NOT NULL THEN s0 END AS src_lang,
  CASE WHEN s0 IS NOT NULL AND t0 IS NOT NULL THEN t0 END AS tgt_lang FROM dir""")
def e12_infer_direction(spark, d):
    r = _records(spark, d).select("id", L.infer_direction("translation").alias("dir"))
    return r.select("id", "dir.src_lang", "dir.tgt_lang")


@register("e13_first_len", W(Q.TURNS, Q.SAMPLES, Q.RAW_MIX) + f"""SELECT id, coalesce(length(
  CASE WHEN contains(messages[1].content, {Q.q(S.FULL_PREFIX)}) THEN {Q.strip_ws(f"replace(messages[1].content, {Q.q(S.FULL_PREFIX)}, '')")}
  ELSE messages[1].content END), 0) AS first_len FROM raw_mix""")
def e13_first_len(spark, d):
    return D.message_metrics(A.sample_turns(spark, d), ["id"]).select("id", "first_len")


@register("e19_stack_systems", W(Q.HYPREF) + f"""SELECT key, system, hyp, ref FROM (
  SELECT key, 'A' AS system, hyp, ref FROM hr UNION ALL SELECT key, 'B' AS system, hyp_b AS hyp, ref FROM hr)""")
def e19_stack_systems(spark, d):
    return SC.stack_systems(A.hyp_ref(spark, d), "key", "ref", {"A": "hyp", "B": "hyp_b"})


# ------------------------------------------------------------- E15..E17 HTML

LO, HI = H.LATIN_ACCENTS
SCRIPT_RE = f"[\\x{{{LO:x}}}-\\x{{{HI:x}}}]"


def _paras(spark, d):
    pg = A.texts(spark, d, "pages")
    return pg.select("page_id", "html", H.with_script_flag(H.paragraphs("html"), LO, HI).alias("ps"))


def _text_sql(x: str) -> str:
    parts = f"string_split(regexp_replace({x}, {Q.q(H.TAG)}, '', 'g'), '&')"
    names = "MAP {" + ", ".join(f"{Q.q(k)}: chr({ord(v)})" for k, v in H.NAMED.items()) + "}"
    ref = f"regexp_extract(p, {Q.q(H.REFERENCE)}, 1)"

    def char(code):
        return (f"CASE WHEN {code} BETWEEN 1 AND {0x10FFFF} AND NOT {code} BETWEEN {0xD800} AND {0xDFFF} "
                f"THEN chr(({code})::INTEGER) ELSE chr({0xFFFD}) END")
    got = (f"CASE WHEN {ref} = '' THEN NULL WHEN lower({ref}[1:2]) = '#x' THEN {char(f"('0x' || {ref}[3:])::BIGINT")} "
           f"WHEN {ref}[1] = '#' THEN {char(f'TRY_CAST({ref}[2:] AS BIGINT)')} ELSE {names}[{ref}] END")
    return (f"({parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: coalesce({got} || p[length({ref}) + 2:], "
            f"'&' || p)), ''))")


def _strip_sql(x: str) -> str:
    for pat in H.NON_CONTENT:
        x = f"regexp_replace({x}, {Q.q(pat)}, '', 'g')"
    return x


PARAS_SQL = f"""segs AS (SELECT page_id, html, string_split_regex({_strip_sql('html')}, {Q.q(H.P_START)}) AS parts FROM pages),
paras AS (
  SELECT page_id, pos - 2 AS pos, {_text_sql(f"regexp_replace(seg, {Q.q(H.P_END)}, '')")} AS text FROM (
    SELECT page_id, unnest(parts) AS seg, generate_subscripts(parts, 1) AS pos FROM segs)
  WHERE pos > 1),
paras_f AS (SELECT *, regexp_matches(text, {Q.q(SCRIPT_RE)}) AS has_script FROM paras)"""


@register("e15_paragraphs", W(PARAS_SQL) + "SELECT page_id, pos, text, has_script FROM paras_f")
def e15_paragraphs(spark, d):
    x = _paras(spark, d).select("page_id", F.explode("ps").alias("p"))
    return x.select("page_id", F.col("p.pos").cast("long").alias("pos"), "p.text", "p.has_script")


@register("e16_first_valid", W(PARAS_SQL) + f"""SELECT page_id, (SELECT text FROM paras_f p
  WHERE p.page_id = pg.page_id AND p.has_script AND p.text <> {Q.q(S.SENTINEL_LABEL)} ORDER BY pos LIMIT 1) AS candidate
  FROM pages pg""")
def e16_first_valid(spark, d):
    return _paras(spark, d).select("page_id", H.first_valid("ps").alias("candidate"))


def _valid_sql(x: str) -> str:
    return (f"coalesce(length({x}) > 0 AND NOT starts_with({x}, {Q.q(S.ERROR_PREFIX)}) AND {x} <> {Q.q(S.SENTINEL_LABEL)} "
            f"AND regexp_matches({x}, {Q.q(SCRIPT_RE)}), false)")


E17_C = f"""c AS (
  SELECT pg.page_id, {_text_sql("regexp_extract(pg.html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS c1,
         p0.text AS c2, p1.text AS c3
  FROM pages pg LEFT JOIN paras p0 ON p0.page_id = pg.page_id AND p0.pos = 0
                LEFT JOIN paras p1 ON p1.page_id = pg.page_id AND p1.pos = 1)"""


@register("e17_ordered_fallback", W(PARAS_SQL, E17_C) + f"""SELECT page_id,
  CASE WHEN {_valid_sql('c1')} THEN c1 WHEN {_valid_sql('c2')} THEN c2 WHEN {_valid_sql('c3')} THEN c3 END AS chosen FROM c""")
def e17_ordered_fallback(spark, d):
    x = _paras(spark, d)
    cands = [H.title("html"), F.get("ps", 0)["text"], F.get("ps", 1)["text"]]
    return x.select("page_id", H.first_valid_of(cands, LO, HI).alias("chosen"))
