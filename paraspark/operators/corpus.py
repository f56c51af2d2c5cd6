"""Corpus-level operators: union/dedupe, accounting, deterministic split,
seeded sampling, batching and export records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.functions import lang as L
from paraspark.operators.digest import digest_groups
from paraspark.operators.ranking import with_row_index

FIELDS = S.PAIR_COLUMNS
#: Rows that the split ranks in one task at most.
RANKED = 100_000


def escape_breaks(c: Column) -> Column:
    """Backslashes and line breaks as two-character escapes."""
    for plain, esc in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(esc))
    return c


def unescape_breaks(c: Column) -> Column:
    """The inverse of ``escape_breaks``: texts between escaped backslashes."""
    parts = F.transform(F.split(c, "\\\\\\\\", -1), lambda p: F.replace(
        F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(parts, "\\")


def scraped_rows(doc: DataFrame) -> DataFrame:
    """A4 shape -> canonical rows (explode + C5 rename + C10)."""
    x = doc.select(F.explode("translations").alias("t"))
    return x.select(L.normalize_lang("t.source_lang").alias("source_lang"),
                    F.col("t.source").alias("source_text"),
                    L.normalize_lang("t.target_lang").alias("target_lang"),
                    F.col("t.target").alias("target_text"))


def block_rows(blocks: DataFrame) -> DataFrame:
    """A5 shape -> canonical rows (posexplode + C9 + C10)."""
    parts = L.split_direction("direction")
    x = blocks.select(parts.alias("dir"),
                      F.posexplode_outer("pairs").alias("pos", "pair")).filter(F.col("pos").isNotNull())
    return x.select(L.normalize_lang(F.col("dir")[0]).alias("source_lang"),
                    F.col("pair.texte_cible").alias("source_text"),
                    L.normalize_lang(F.col("dir")[1]).alias("target_lang"),
                    F.col("pair.traduction").alias("target_text"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL with a source ordinal (first frame first)."""
    out = None
    for i, f in enumerate(frames):
        g = f.select(*FIELDS).withColumn("source_ord", F.lit(i))
        out = g if out is None else out.unionByName(g)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    """The corpus builder: union, then exact dedupe on the four columns;
    ``source_ord`` says which source had a row first."""
    return union_sources(*frames).groupBy(*FIELDS).agg(F.min("source_ord").alias("source_ord"))


def dedupe_accounting(df: DataFrame) -> DataFrame:
    """loaded, unique and removed counts in one pass; 32 bytes per distinct
    row and task are shuffled, not the texts."""
    groups = digest_groups(df, FIELDS)
    return (groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("loaded"), F.count(F.lit(1)).alias("unique_rows"))
            .withColumn("removed", F.col("loaded") - F.col("unique_rows")))


def hash_order(key: Column, seed: int = S.SPLIT_SEED) -> Column:
    """Deterministic pseudo-random order key: md5(seed ':' key)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_train_test(df: DataFrame, key: str, test_fraction: float = S.TEST_FRACTION,
                     seed: int = S.SPLIT_SEED) -> DataFrame:
    """H4: adds ``split`` in {train, test}; the first ceil(f*n) rows by
    (md5(seed:key), key) are test. Deterministic, disjoint, exact size.

    Only the boundary is needed: rows are counted by the next four hex digits
    of the hash (at most 65,536 counts) within the group that holds the
    ceil(f*n)-th row, as often as that group has more than ``RANKED`` rows (a
    second time from about 6 * 10^9 rows on), and only the last group is
    ranked; one row is read back to the driver and membership is a per-row
    comparison, so the table is neither sorted, numbered nor shuffled. ``key``
    must be unique and non-null.
    """
    n = df.count()
    n_test = -(-int(round(test_fraction * n * 1_000_000)) // 1_000_000)  # ceil without float drift
    h = hash_order(F.col(key), seed)
    if n_test <= 0:
        return df.withColumn("split", F.lit("train"))
    keys = df.select(h.alias("_h"), F.col(key).alias("_k"))
    prefix, inside, size = "", n_test, n
    while size > RANKED and len(prefix) < 32:
        near = keys.filter(F.startswith("_h", F.lit(prefix)))
        groups = near.groupBy(F.substring("_h", len(prefix) + 1, 4).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0))
        hit = (groups.withColumn("_upto", upto).filter((F.col("_upto") >= inside) & (F.col("_upto") - F.col("_n") < inside))
               .first())
        prefix, inside, size = prefix + hit["_g"], inside - (hit["_upto"] - hit["_n"]), hit["_n"]
    edge = (keys.filter(F.startswith("_h", F.lit(prefix)))
            .withColumn("_rank", F.row_number().over(Window.orderBy("_h", "_k"))).filter(F.col("_rank") == inside).first())
    in_test = (h < F.lit(edge["_h"])) | ((h == F.lit(edge["_h"])) & (F.col(key) <= F.lit(edge["_k"])))
    return df.withColumn("split", F.when(in_test, F.lit("test")).otherwise(F.lit("train")))


def seeded_sample(df: DataFrame, key: str, k: int = S.PREVIEW_K, seed: int = S.SPLIT_SEED) -> DataFrame:
    """H5/H6: the first ``k`` rows of the seeded order (top-k, no full sort)."""
    return df.orderBy(hash_order(F.col(key), seed), F.col(key)).limit(k)


def batches(df: DataFrame, order_cols: list[str], size: int = S.QUESTION_BATCH, n: int | None = None) -> DataFrame:
    """H7: batch number floor((row_number-1)/size) and rows per batch, for a
    request of ``n`` rows (all when not given): the result is cut to ``n``, so
    the last batch may be smaller. Only the order columns are numbered."""
    idx = with_row_index(df.select(*order_cols), order_cols, "_i")
    if n is not None:
        idx = idx.filter(F.col("_i") <= n)
    return (idx.withColumn("batch", F.floor((F.col("_i") - 1) / size).cast("long"))
            .groupBy("batch").agg(F.count(F.lit(1)).alias("items")))


def training_records(df: DataFrame) -> DataFrame:
    """C6 -> C11 -> E14: one ``translation`` map per exportable row; the
    direction is kept next to it because a map does not keep key order."""
    ok = df.filter(L.is_exportable("source_lang", "target_lang", "source_text", "target_text"))
    return ok.select(
        *([c for c in ["id"] if c in df.columns]),
        L.model_code("source_lang").alias("src_code"),
        L.model_code("target_lang").alias("tgt_code"),
        L.translation_map("source_lang", "source_text", "target_lang", "target_text").alias("translation"))
