"""Scoring and run-metric analytics: corpus BLEU, system comparison,
best checkpoint, retention and latest values.

BLEU follows the published definition (Papineni et al. 2002) with the
13a tokenisation and exponential smoothing of Post (2018). The corpus
statistics are sums of per-row n-gram matches, so they are computed as
joins and aggregates over exploded n-grams; no row set is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.functions import text as T

MAX_ORDER = 4

# 13a tokenisation rules (regex, replacement), applied in this order.
TOKENIZE_13A = [
    ("([\\{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])", " $1 "),
    ("([^0-9])([\\.,])", "$1 $2 "),
    ("([\\.,])([^0-9])", " $1 $2"),
    ("([0-9])(-)", "$1 $2 "),
]


def tokenize_13a(c) -> Column:
    """Whole-text 13a tokenisation -> ARRAY<STRING>."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(x, S.WS_CLASS + "+\\z", "")  # rstrip first
    x = F.replace(x, F.lit("<skipped>"), F.lit(""))
    x = F.replace(x, F.lit("-\n"), F.lit(""))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    x = F.replace(x, F.lit("&quot;"), F.lit('"'))
    x = F.replace(x, F.lit("&amp;"), F.lit("&"))
    x = F.replace(x, F.lit("&lt;"), F.lit("<"))
    x = F.replace(x, F.lit("&gt;"), F.lit(">"))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for pat, rep in TOKENIZE_13A:
        x = F.regexp_replace(x, pat, rep)
    return T.ws_tokens(x)


def _ngram_orders(tokens: Column) -> list[Column]:
    """[1-grams, 2-grams, ..., MAX_ORDER-grams] of a token array; order n is
    built from order n-1 by pairing it with the tokens shifted by n-1, so each
    order costs one pass over the row."""
    size = F.size(tokens)
    orders = [tokens]
    prev = tokens
    for n in range(2, MAX_ORDER + 1):
        count = F.greatest(size - (n - 1), F.lit(0))
        nxt = F.zip_with(F.slice(prev, 1, count), F.slice(tokens, n, count),
                         lambda a, b: F.concat(a, F.lit(" "), b))
        nxt = F.when(size >= n, nxt).otherwise(F.array().cast("array<string>"))
        orders.append(nxt)
        prev = nxt
    return orders


def bleu_stats(df: DataFrame, group: list[str], key: str, hyp: str, ref: str) -> DataFrame:
    """Per group: sys_len, ref_len, and correct_n / total_n for n = 1..4.

    Both sides' n-grams are exploded into one stream with a side flag and
    counted by one aggregation keyed by (group, row, n, gram): hc and rc are
    the hypothesis and reference counts of a gram in a row. Every statistic
    is a sum over those counts (sys_len = hc at n=1, ref_len = rc at n=1,
    total_n = hc at order n, correct_n = least(hc, rc) at order n), so the
    input is read and tokenised once and no join or union is needed.

    The rows are hash-partitioned by ``key`` before exploding: that
    partitioning already satisfies the (group, row, n, gram) aggregation, so
    the text rows are shuffled once and the exploded grams (about ten times
    the text volume) are counted where they are produced, never shuffled.
    The partition count is fixed (the session's shuffle partitions, at least
    the default parallelism) so the runtime does not coalesce the n-gram
    work into a few tasks. ``key`` identifies one segment (a handful of rows per key, one per
    system), so no partition is hot.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tok = (df.repartition(parts, F.col(key))
           .select(*group, key, tokenize_13a(hyp).alias("_h"), tokenize_13a(ref).alias("_r")))
    sides = [F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), g.alias("g"))
             for side, col in (("h", "_h"), ("r", "_r"))
             for n, g in enumerate(_ngram_orders(F.col(col)), start=1)]
    grams = (tok.select(*group, key, F.explode(F.array(*sides)).alias("_x"))
             .select(*group, key, F.col("_x.side").alias("side"), F.col("_x.n").alias("n"),
                     F.explode("_x.g").alias("gram")))
    counts = grams.groupBy(*group, key, "n", "gram").agg(
        F.sum(F.when(F.col("side") == "h", 1).otherwise(0)).alias("hc"),
        F.sum(F.when(F.col("side") == "r", 1).otherwise(0)).alias("rc"))
    orders = range(1, MAX_ORDER + 1)

    def at(n: int, v: Column) -> Column:
        return F.sum(F.when(F.col("n") == n, v).otherwise(F.lit(0))).cast("long")

    return counts.groupBy(*group).agg(
        at(1, F.col("hc")).alias("sys_len"), at(1, F.col("rc")).alias("ref_len"),
        *[at(n, F.col("hc")).alias(f"total_{n}") for n in orders],
        *[at(n, F.least("hc", "rc")).alias(f"correct_{n}") for n in orders])


def bleu_from_stats(stats: DataFrame, group: list[str]) -> DataFrame:
    """Corpus BLEU (0..100) with 'exp' smoothing from the summed statistics;
    0 when no n-gram of any order matches (nothing to smooth)."""
    logs = []
    mult = F.lit(1.0)
    stop = F.lit(False)
    for n in range(1, MAX_ORDER + 1):
        c, t = F.col(f"correct_{n}").cast("double"), F.col(f"total_{n}").cast("double")
        stop = stop | (t == 0)
        mult = F.when(c == 0, mult * 2).otherwise(mult)
        p = F.when(stop, F.lit(0.0)).when(c == 0, F.lit(100.0) / (mult * t)).otherwise(F.lit(100.0) * c / t)
        logs.append(F.when(p == 0, F.lit(-9999999999.0)).otherwise(F.log(p)))
    sys_len, ref_len = F.col("sys_len").cast("double"), F.col("ref_len").cast("double")
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(F.lit(0.0))
    none = F.lit(True)
    for n in range(1, MAX_ORDER + 1):
        none = none & (F.col(f"correct_{n}") == 0)
    score = F.when(none, F.lit(0.0)).otherwise(bp * F.exp(sum(logs[1:], logs[0]) / MAX_ORDER))
    return stats.select(*group, F.col("sys_len").cast("long").alias("sys_len"),
                        F.col("ref_len").cast("long").alias("ref_len"), score.alias("bleu"))


def corpus_bleu(df: DataFrame, hyp: str, ref: str, key: str, group: list[str] | None = None) -> DataFrame:
    """one BLEU per group (one row when ``group`` is empty)."""
    group = list(group or [])
    if not group:
        d = df.withColumn("_all", F.lit(1))
        return bleu_from_stats(bleu_stats(d, ["_all"], key, hyp, ref), ["_all"]).drop("_all")
    return bleu_from_stats(bleu_stats(df, group, key, hyp, ref), group)


def corpus_bleu_systems(df: DataFrame, key: str, ref: str, systems: dict[str, str]) -> DataFrame:
    """F15 on wide predictions: one BLEU row per system, the reference read,
    tokenised and exploded once for all systems.

    Same counting as ``bleu_stats``: one aggregation keyed by (row, n, gram)
    holds the reference count and one hypothesis count per system, after the
    rows are hash-partitioned by ``key`` (n-grams are counted where they are
    produced). Output columns: system, sys_len, ref_len, bleu.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = list(systems)
    cols = {name: f"_h{i}" for i, name in enumerate(names)}
    tok = (df.repartition(parts, F.col(key))
           .select(key, tokenize_13a(ref).alias("_r"),
                   *[tokenize_13a(systems[name]).alias(cols[name]) for name in names]))
    sides = [F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), g.alias("g"))
             for side, col in [("_r", "_r")] + [(cols[name], cols[name]) for name in names]
             for n, g in enumerate(_ngram_orders(F.col(col)), start=1)]
    grams = (tok.select(key, F.explode(F.array(*sides)).alias("_x"))
             .select(key, F.col("_x.side").alias("side"), F.col("_x.n").alias("n"),
                     F.explode("_x.g").alias("gram")))
    counts = grams.groupBy(key, "n", "gram").agg(
        *[F.sum(F.when(F.col("side") == c, 1).otherwise(0)).alias(c) for c in ["_r"] + [cols[n] for n in names]])
    orders = range(1, MAX_ORDER + 1)

    def at(n: int, v: Column) -> Column:
        return F.sum(F.when(F.col("n") == n, v).otherwise(F.lit(0))).cast("long")

    wide = counts.agg(at(1, F.col("_r")).alias("ref_len"), *[
        x for name in names for x in (
            at(1, F.col(cols[name])).alias(f"{cols[name]}_sys_len"),
            *[at(n, F.col(cols[name])).alias(f"{cols[name]}_total_{n}") for n in orders],
            *[at(n, F.least(cols[name], "_r")).alias(f"{cols[name]}_correct_{n}") for n in orders])])
    stat_cols = ["sys_len"] + [f"total_{n}" for n in orders] + [f"correct_{n}" for n in orders]
    per_system = wide.select(F.col("ref_len"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("system"), *[F.col(f"{cols[name]}_{c}").alias(c) for c in stat_cols])
        for name in names])).alias("_s")).select("_s.*", "ref_len")
    return bleu_from_stats(per_system, ["system"])


def stack_systems(df: DataFrame, key: str, ref: str, systems: dict[str, str]) -> DataFrame:
    """Wide prediction columns -> (key, system, hyp, ref)."""
    return df.select(key, ref, F.explode(F.array(*[
        F.struct(F.lit(name).alias("system"), F.col(col).alias("hyp")) for name, col in systems.items()
    ])).alias("_s")).select(key, "_s.system", "_s.hyp", ref)


def best_step(df: DataFrame, keys: list[str], greater_is_better: bool = True) -> DataFrame:
    """F16: step with the best value per run (ties -> earliest step), as an
    aggregate (partial + final; a run holding most rows is still one row per task)."""
    v = F.col("value") if greater_is_better else -F.col("value")
    order = F.struct(v.alias("v"), (-F.col("step")).alias("s"))
    return df.groupBy(*keys).agg(F.max_by(F.struct("step", "value"), order).alias("_b")).select(
        *keys, F.col("_b.step").alias("best_step"), F.col("_b.value").alias("best_value"))


def kept_checkpoints(df: DataFrame, keys: list[str], k: int = S.CHECKPOINT_KEEP,
                     greater_is_better: bool = True) -> DataFrame:
    """the best step plus the newest k-1 others per run (k in total).

    ``row_number() <= k`` is planned as a window group limit, so each map task
    keeps only k rows per run before the shuffle; they meet the run's best
    step (one row per run), never the whole log. If the best is not among the
    newest k, it takes the place of the last of them.
    """
    from pyspark.sql import Window
    best = best_step(df, keys, greater_is_better).select(*keys, F.col("best_step"))
    w = Window.partitionBy(*keys).orderBy(F.desc("step"))
    newest = (df.select(*keys, "step").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
              .groupBy(*keys).agg(F.sort_array(F.collect_list("step"), asc=False).alias("_new")))  # at most k steps
    j = newest.join(best, keys)
    others = F.slice(F.array_except("_new", F.array("best_step")), 1, k - 1)
    return (j.select(*keys, F.explode(F.concat(F.array("best_step"), others)).alias("step"), "best_step")
            .select(*keys, "step", (F.col("step") == F.col("best_step")).alias("is_best")))


def latest_value(df: DataFrame, keys: list[str]) -> DataFrame:
    """value at the largest step per key (aggregate, no window)."""
    return df.groupBy(*keys).agg(F.max("step").alias("last_step"), F.max_by("value", "step").alias("last_value"))
