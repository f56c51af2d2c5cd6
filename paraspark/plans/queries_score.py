"""Registered queries: F14-F18 (BLEU and run metrics) and M1-M2 (encoding)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.operators import encode as EN
from paraspark.operators import score as SC
from paraspark.operators import table as TB
from paraspark.plans import adapters as A
from paraspark.plans import pipelines as P
from paraspark.plans import sqltext as Q
from paraspark.plans.registry import register

W = Q.with_


# ------------------------------------------------------------------ BLEU

def _tok_sql(x: str) -> str:
    t = f"regexp_replace({x}, {Q.q(S.WS_CLASS + '+' + chr(92) + 'z')}, '')"
    for a, b in [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        t = f"replace({t}, {Q.q(a)}, {Q.q(b)})"
    t = f"' ' || {t} || ' '"
    for pat, rep in SC.TOKENIZE_13A:
        t = f"regexp_replace({t}, {Q.q(pat)}, {Q.q(rep.replace('$', chr(92)))}, 'g')"
    return f"list_filter(string_split_regex({Q.strip_ws(t)}, {Q.q(S.WS_CLASS + '+')}), lambda w: w <> '')"


STACKED = """stacked AS (
  SELECT key, 'A' AS system, hyp, ref FROM hr UNION ALL SELECT key, 'B' AS system, hyp_b AS hyp, ref FROM hr)"""


# BLEU is reported to 6 decimals on both sides (exp/log of sums whose order
# differs between engines)
BLEU_DIGITS = 6


def _bleu_sql(src: str, group: str) -> str:
    """Corpus BLEU per ``group`` (a column of ``src``) in plain SQL."""
    g = group
    ctes = f"""tok AS (SELECT key, {g} AS grp, {_tok_sql('hyp')} AS h, {_tok_sql('ref')} AS r FROM {src}),
hg0 AS (SELECT key, grp, n, h, unnest(generate_series(1, len(h) - n + 1)) AS i FROM tok, range(1, 5) nn(n)),
hg AS (SELECT key, grp, n, array_to_string(list_slice(h, i, i + n - 1), ' ') AS gram, count(*) AS hc FROM hg0 GROUP BY ALL),
rg0 AS (SELECT key, grp, n, r, unnest(generate_series(1, len(r) - n + 1)) AS i FROM tok, range(1, 5) nn(n)),
rg AS (SELECT key, grp, n, array_to_string(list_slice(r, i, i + n - 1), ' ') AS gram, count(*) AS rc FROM rg0 GROUP BY ALL),
clip AS (SELECT h.grp, h.n, sum(least(h.hc, coalesce(r.rc, 0))) AS correct
         FROM hg h LEFT JOIN rg r ON r.key = h.key AND r.grp = h.grp AND r.n = h.n AND r.gram = h.gram GROUP BY ALL),
lens AS (SELECT grp, sum(len(h)) AS sys_len, sum(len(r)) AS ref_len,
         {", ".join(f"sum(greatest(len(h) - {n - 1}, 0)) AS t{n}" for n in range(1, 5))} FROM tok GROUP BY grp),
st AS (SELECT l.*, {", ".join(f"coalesce((SELECT correct FROM clip c WHERE c.grp = l.grp AND c.n = {n}), 0) AS c{n}" for n in range(1, 5))}
       FROM lens l)"""
    logs, stop, mult = [], "false", "1.0"
    for n in range(1, 5):
        stop = f"({stop} OR t{n} = 0)"
        mult = f"(CASE WHEN c{n} = 0 THEN {mult} * 2 ELSE {mult} END)"
        p = (f"(CASE WHEN {stop} THEN 0.0 WHEN c{n} = 0 THEN 100.0 / ({mult} * t{n}) "
             f"ELSE 100.0 * c{n} / t{n} END)")
        logs.append(f"(CASE WHEN {p} = 0 THEN -9999999999.0 ELSE ln({p}) END)")
    bp = ("(CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1 - CAST(ref_len AS DOUBLE) / sys_len) "
          "ELSE 0.0 END)")
    return ctes, (f"SELECT grp, CAST(sys_len AS BIGINT) AS sys_len, CAST(ref_len AS BIGINT) AS ref_len, "
                  f"CASE WHEN c1 + c2 + c3 + c4 = 0 THEN 0.0 ELSE round({bp} * exp(({' + '.join(logs)}) / 4), {BLEU_DIGITS}) END::DOUBLE AS bleu FROM st")


_C14, _S14 = _bleu_sql("hr", "'all'")
_C15, _S15 = _bleu_sql("stacked", "system")


@register("f14_corpus_bleu", W(Q.HYPREF, _C14) + _S14.replace("SELECT grp, ", "SELECT "))
def f14_corpus_bleu(spark, d):
    """System A (assistant turn) scored against the preceding user turn."""
    return SC.corpus_bleu(A.hyp_ref(spark, d), "hyp", "ref", "key").withColumn("bleu", F.round("bleu", BLEU_DIGITS))


@register("f15_compare_systems", W(Q.HYPREF, STACKED, _C15) + _S15.replace("SELECT grp, ", "SELECT grp AS system, "))
def f15_compare_systems(spark, d):
    """Systems A and B against the same references (wide form: each
    reference is tokenised and exploded once for both systems)."""
    out = SC.corpus_bleu_systems(A.hyp_ref(spark, d), "key", "ref", {"A": "hyp", "B": "hyp_b"})
    return out.withColumn("bleu", F.round("bleu", BLEU_DIGITS))


# ----------------------------------------------------------- run metrics

ML = """ml AS (
  SELECT 'run' || CAST(user_id AS VARCHAR) AS run_id, event_type AS metric, epoch_us(ts) // 1000 AS ts_ms, value, event_id AS step
  FROM events)"""
BEST = """best AS (
  SELECT run_id, metric, step AS best_step, value AS best_value FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, metric ORDER BY value DESC, step) AS rn FROM ml) WHERE rn = 1)"""
KEYS = ["run_id", "metric"]


@register("f16_best_step", W(ML, BEST) + "SELECT * FROM best")
def f16_best_step(spark, d):
    return SC.best_step(A.metric_log(spark, d), KEYS)


@register("f17_kept_checkpoints", W(ML, BEST) + f"""SELECT run_id, metric, step, false AS is_best FROM (
  SELECT m.*, row_number() OVER (PARTITION BY m.run_id, m.metric ORDER BY m.step DESC) AS rn
  FROM ml m JOIN best b USING (run_id, metric) WHERE m.step <> b.best_step) WHERE rn <= {S.CHECKPOINT_KEEP - 1}
UNION ALL SELECT run_id, metric, best_step AS step, true AS is_best FROM best""")
def f17_kept_checkpoints(spark, d):
    return SC.kept_checkpoints(A.metric_log(spark, d), KEYS, S.CHECKPOINT_KEEP)


@register("f18_latest_value", W(ML) + "SELECT run_id, metric, max(step) AS last_step, arg_max(value, step) AS last_value FROM ml GROUP BY ALL")
def f18_latest_value(spark, d):
    return SC.latest_value(A.metric_log(spark, d), KEYS)


# -------------------------------------------------------------- encoding

def _exportable(spark, d):
    return P.exportable(TB.normalise_langs(A.translations(spark, d)))


def _toks_sql(col: str) -> str:
    return (f"SELECT id, '{col}' AS field, unnest(tk) AS token, generate_subscripts(tk, 1) - 1 AS pos FROM ("
            f"SELECT id, list_filter(string_split_regex({Q.strip_ws(col)}, {Q.q(S.WS_CLASS + '+')}), lambda w: w <> '') AS tk FROM ex)")


M1_CTES = f"""ex AS (SELECT id, source_text, target_text FROM trn WHERE {Q.exportable()}),
toks AS ({_toks_sql('source_text')} UNION ALL {_toks_sql('target_text')}),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS tok_id FROM toks GROUP BY token),
seqs AS (SELECT t.id, t.field, list(v.tok_id ORDER BY t.pos) AS ids FROM toks t JOIN vocab v USING (token)
         WHERE t.pos < {S.SEQ_LEN} GROUP BY ALL)"""


def _pad(x: str) -> str:
    return (f"array_to_string(list_concat(coalesce({x}, []), list_transform(range({S.SEQ_LEN} - coalesce(len({x}), 0)), "
            f"lambda z: 0)), ' ')")


@register("m1_encode", W(Q.TR, Q.TRN, M1_CTES) + f"""SELECT e.id, {_pad('s.ids')} AS source_ids, {_pad('t.ids')} AS target_ids
  FROM ex e LEFT JOIN seqs s ON s.id = e.id AND s.field = 'source_text'
            LEFT JOIN seqs t ON t.id = e.id AND t.field = 'target_text'""")
def m1_encode(spark, d):
    enc = EN.encode(_exportable(spark, d), "id", ["source_text", "target_text"])
    as_text = [F.array_join(F.transform(c, lambda x: x.cast("string")), " ") for c in ("source_text_ids", "target_text_ids")]
    return enc.select("id", as_text[0].alias("source_ids"), as_text[1].alias("target_ids"))


def _cut_sql(col: str) -> str:
    n = f"len(list_filter(string_split_regex({Q.strip_ws(col)}, {Q.q(S.WS_CLASS + '+')}), lambda w: w <> ''))"
    return f"CAST(sum(CASE WHEN {n} > {S.SEQ_LEN} THEN 1 ELSE 0 END) AS BIGINT)"


@register("m2_truncation", W(Q.TR, Q.TRN) + f"""SELECT source_lang, count(*) AS rows, {_cut_sql('source_text')} AS truncated_source_text,
  {_cut_sql('target_text')} AS truncated_target_text FROM trn WHERE {Q.exportable()} GROUP BY source_lang""")
def m2_truncation(spark, d):
    return EN.truncation_report(_exportable(spark, d), "source_lang", ["source_text", "target_text"])
