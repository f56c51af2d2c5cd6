"""Registered queries: F1-F13, F19, F20 (profiling and dedupe)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.operators import corpus as CO
from paraspark.operators import dialogue as D
from paraspark.operators import digest as DG
from paraspark.operators import profile as PR
from paraspark.operators import table as TB
from paraspark.plans import adapters as A
from paraspark.plans import pipelines as P
from paraspark.plans import sqltext as Q
from paraspark.plans.registry import register

W = Q.with_
MIX = W(Q.TURNS, Q.SAMPLES, Q.RAW_MIX)


def _trn(spark, d):
    return TB.normalise_langs(A.translations(spark, d))


def _mix_metrics(spark, d):
    """Per sample: JSON length of the messages, message count, first-message length."""
    return D.message_metrics(A.sample_turns(spark, d), ["id", "direction"])


MIX_METRICS_SQL = MIX.rstrip("\n") + f""",
mx AS (
  SELECT id, direction, length(CAST(to_json(messages) AS VARCHAR)) AS json_len, len(messages) AS n_messages,
         coalesce(length(CASE WHEN contains(messages[1].content, {Q.q(S.FULL_PREFIX)})
                              THEN {Q.strip_ws(f"replace(messages[1].content, {Q.q(S.FULL_PREFIX)}, '')")}
                              ELSE messages[1].content END), 0) AS first_len
  FROM raw_mix)
"""


@register("f1_count", MIX + "SELECT count(*) AS rows FROM raw_mix")
def f1_count(spark, d):
    return PR.total_rows(A.samples(spark, d))


@register("f2_count_by_direction", MIX + "SELECT direction, count(*) AS count FROM raw_mix GROUP BY direction")
def f2_count_by_direction(spark, d):
    return PR.count_by(A.samples(spark, d), "direction")


@register("f3_count_by_dataset", MIX + "SELECT dataset, count(*) AS count FROM raw_mix GROUP BY dataset")
def f3_count_by_dataset(spark, d):
    return PR.count_by(A.samples(spark, d), "dataset")


@register("f4_value_counts", "SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def f4_value_counts(spark, d):
    return PR.count_by(A.table(spark, d, "documents"), "lang", drop_null=True)


@register("f5_pairs_per_lang", W(Q.TR, Q.TRN) + "SELECT source_lang, target_lang, count(*) AS total FROM trn GROUP BY ALL")
def f5_pairs_per_lang(spark, d):
    return P.pairs_per_language_pair(_trn(spark, d))


@register("f6_ambiguous_source", W(Q.TR, Q.TRN) + """SELECT source_lang, source_text, target_lang, count(*) AS occurrences
  FROM trn GROUP BY ALL HAVING count(*) > 1""")
def f6_ambiguous_source(spark, d):
    return DG.repeated_keys(_trn(spark, d), ["source_lang", "source_text", "target_lang"], row_key="id")


@register("f7_total_pairs", W(Q.TURNS, Q.SAMPLES, Q.greedy_ctes(), Q.FLAT_PAIRS) + "SELECT count(*) AS total_pairs FROM flat")
def f7_total_pairs(spark, d):
    p = D.pair_counts_long(P.keep_directions(A.sample_turns(spark, d)), ["id"])
    return p.agg(F.sum("n_pairs").alias("total_pairs"))


# Float summaries are reported to 6 decimals on both sides: the engines sum
# in different orders, so raw doubles may differ in the last bits.
DIGITS = 6


def _rounded(df, cols):
    return df.select(*[F.round(c, DIGITS).alias(c) if c in cols else F.col(c) for c in df.columns])


def _five_sql(col: str) -> str:
    return (f"SELECT count({col}) AS count, round(avg({col}), {DIGITS}) AS mean, "
            f"round(stddev_samp({col}), {DIGITS}) AS stddev, "
            f"CAST(min({col}) AS DOUBLE) AS min, CAST(max({col}) AS DOUBLE) AS max FROM mx")


@register("f8_json_length_summary", MIX_METRICS_SQL + _five_sql("json_len"))
def f8_json_length_summary(spark, d):
    return _rounded(PR.five_number(_mix_metrics(spark, d), "json_len"), ["mean", "stddev"])


@register("f8_messages_summary", MIX_METRICS_SQL + _five_sql("n_messages"))
def f8_messages_summary(spark, d):
    return _rounded(PR.five_number(_mix_metrics(spark, d), "n_messages"), ["mean", "stddev"])


@register("f9_first_len_summary", MIX_METRICS_SQL + f"""SELECT count(first_len) AS count, round(avg(first_len), {DIGITS}) AS mean,
  round(stddev_samp(first_len), {DIGITS}) AS stddev, CAST(min(first_len) AS DOUBLE) AS min, CAST(max(first_len) AS DOUBLE) AS max,
  round(quantile_cont(first_len, 0.25), {DIGITS}) AS q25, round(quantile_cont(first_len, 0.5), {DIGITS}) AS q50,
  round(quantile_cont(first_len, 0.75), {DIGITS}) AS q75 FROM mx""")
def f9_first_len_summary(spark, d):
    return _rounded(PR.eight_number(_mix_metrics(spark, d), "first_len"), ["mean", "stddev", "q25", "q50", "q75"])


@register("f10_mean_by_direction", MIX_METRICS_SQL + """SELECT direction, round(avg(first_len), 2) AS mean
  FROM mx WHERE direction IS NOT NULL GROUP BY direction""")
def f10_mean_by_direction(spark, d):
    return PR.mean_by(_mix_metrics(spark, d), "direction", "first_len")


def _hist_sql(col: str, bins: int) -> str:
    return MIX_METRICS_SQL.rstrip("\n") + f""",
st0 AS (SELECT CAST(min({col}) AS DOUBLE) AS lo0, CAST(max({col}) AS DOUBLE) AS hi0 FROM mx),
st AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM st0),
b AS (SELECT CAST(least(floor((CAST({col} AS DOUBLE) - lo) * {bins} / (hi - lo)) + 1, {bins}) AS INTEGER) AS bin FROM mx, st WHERE {col} IS NOT NULL),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
e AS (SELECT CAST(r AS INTEGER) AS bin, lo + (r - 1) * (hi - lo) / {bins} AS bin_start, lo + r * (hi - lo) / {bins} AS bin_end
      FROM st, range(1, {bins} + 1) t(r))
SELECT e.bin, e.bin_start, e.bin_end, coalesce(c.count, 0) AS count FROM e LEFT JOIN c USING (bin)"""


@register("f11_histogram_json_length", _hist_sql("json_len", 50))
def f11_histogram_json_length(spark, d):
    return PR.histogram(_mix_metrics(spark, d), "json_len", 50)


@register("f11_histogram_messages", _hist_sql("n_messages", 20))
def f11_histogram_messages(spark, d):
    return PR.histogram(_mix_metrics(spark, d), "n_messages", 20)


@register("f12_exact_dedupe", W(Q.TR, Q.TRN) + "SELECT DISTINCT source_lang, source_text, target_lang, target_text FROM trn")
def f12_exact_dedupe(spark, d):
    return P.unique_pairs(_trn(spark, d))


@register("f13_dedupe_accounting", W(Q.TR, Q.TRN) + """SELECT count(*) AS loaded,
  count(DISTINCT (source_lang, source_text, target_lang, target_text)) AS unique_rows,
  count(*) - count(DISTINCT (source_lang, source_text, target_lang, target_text)) AS removed FROM trn""")
def f13_dedupe_accounting(spark, d):
    return CO.dedupe_accounting(_trn(spark, d))


@register("f19_dataset_profile", """SELECT count(*) AS rows, CASE WHEN count(*) < 1000 THEN 'n<1K'
  WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' WHEN count(*) < 1000000 THEN '100K<n<1M'
  WHEN count(*) < 10000000 THEN '1M<n<10M' WHEN count(*) < 100000000 THEN '10M<n<100M' WHEN count(*) < 1000000000 THEN '100M<n<1B'
  WHEN count(*) < 10000000000 THEN '1B<n<10B' WHEN count(*) < 100000000000 THEN '10B<n<100B'
  WHEN count(*) < 1000000000000 THEN '100B<n<1T' ELSE 'n>1T' END AS size_category, 1::BIGINT AS files FROM lineitem""")
def f19_dataset_profile(spark, d):
    """Rows, distinct source files (the given table is one file) and size."""
    return PR.dataset_profile(A.table(spark, d, "lineitem"))


@register("f20_completeness", """SELECT v."column", v."type", c.non_null
  FROM (VALUES ('conv_id', 'bigint'), ('turn', 'bigint'), ('role', 'string'), ('text', 'string')) v("column", "type")
  JOIN (SELECT unnest(['conv_id', 'turn', 'role', 'text']) AS "column",
               unnest([count(conv_id), count(turn), count(role), count(text)]) AS non_null FROM conversations) c
  ON c."column" = v."column"
""")
def f20_completeness(spark, d):
    return PR.completeness(A.table(spark, d, "conversations"))
