"""Profiling operators: counts, summaries, histograms, completeness.

Each profile is one aggregation pass (partial + final), so only a handful of
rows ever reach the driver, never the data itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.operators.ranking import exact_quantiles


def total_rows(df: DataFrame) -> DataFrame:
    """F1."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def count_by(df: DataFrame, *keys: str, drop_null: bool = False, name: str = "count") -> DataFrame:
    """F2/F3 (Spark keeps a NULL group) and F4 (``drop_null``: pandas value_counts),
    largest first with the keys as tie-breakers."""
    src = df
    if drop_null:
        for k in keys:
            src = src.filter(F.col(k).isNotNull())
    return (src.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), *keys))


def five_number(df: DataFrame, col: str) -> DataFrame:
    """F8: count, mean, sample stddev, min, max (numeric columns)."""
    x = F.col(col)
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"),
                  F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"))


def eight_number(df: DataFrame, col: str) -> DataFrame:
    """F8 plus exact linear-interpolated quartiles (distributed ranking,
    no single-buffer percentile). The two one-row results are combined as
    (stat, value) rows and folded by one aggregate: no join."""
    base = five_number(df, col)
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    names = base.columns + q.columns

    def long(x: DataFrame) -> DataFrame:
        return x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v"))
                                              for c in x.columns])).alias("s")).select("s.*")

    folded = long(base).unionByName(long(q)).agg(
        *[F.max(F.when(F.col("stat") == c, F.col("v"))).alias(c) for c in names])
    return folded.withColumn("count", F.col("count").cast("long"))


def mean_by(df: DataFrame, key: str, col: str, digits: int = 2, name: str = "mean") -> DataFrame:
    """rounded mean per key, NULL key dropped (pandas groupby)."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.round(F.avg(col), digits).alias(name)))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """equal-width histogram over [min, max], last bin closed, every bin
    reported (empty ones with 0); min == max widens the range by 0.5 each way.

    The range is two scalars read back from one aggregate; the bin table has
    ``bins`` rows. No data reaches the driver and no join multiplies rows."""
    spark = df.sparkSession
    x = F.col(col).cast("double")
    vals = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    lo, hi = vals.agg(F.min("_x"), F.max("_x")).first()
    if lo is None:
        return spark.createDataFrame([], "bin INT, bin_start DOUBLE, bin_end DOUBLE, count BIGINT")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    flo, fhi, fn = F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)
    binned = vals.select(F.least(F.floor((F.col("_x") - flo) * fn / (fhi - flo)) + 1, fn).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (flo + (F.col("id") - 1) * (fhi - flo) / fn).alias("bin_start"),
        (flo + F.col("id") * (fhi - flo) / fn).alias("bin_end"))
    # edges has ``bins`` rows: a bounded, broadcast-safe side
    return (F.broadcast(edges).join(counts, "bin", "left")
            .select("bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


SIZE_UNITS = ["", "K", "M", "B", "T"]


def size_category(n_col) -> F.Column:
    """Hub-style size bucket: n<1K, 1K<n<10K, ... (decades, by rule)."""
    n = F.col(n_col) if isinstance(n_col, str) else n_col

    def label(e: int) -> str:
        return f"{10 ** (e % 3)}{SIZE_UNITS[e // 3]}"

    out = F.when(n < F.lit(1000), F.lit("n<1K"))
    for e in range(3, 12):
        out = out.when(n < F.lit(10 ** (e + 1)), F.lit(f"{label(e)}<n<{label(e + 1)}"))
    return out.otherwise(F.lit(f"n>{label(12)}"))


def dataset_profile(df: DataFrame, count_files: bool = True) -> DataFrame:
    """rows, source files and size bucket in one pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if count_files:
        aggs.append(F.count_distinct(F.col("_metadata.file_path")).alias("files"))
    return df.agg(*aggs).withColumn("size_category", size_category("rows"))


def completeness(df: DataFrame) -> DataFrame:
    """(column, type, non_null) for every column, from one aggregation pass."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    types = {c: t for c, t in df.dtypes}
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
                              F.col(f"c{i}").alias("non_null")) for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def flatten_card(card_json) -> DataFrame | F.Column:
    """A dataset card (JSON text) -> flat profile struct with defaults for
    missing keys (downloads 0, likes 0, gated/disabled false, lists empty).
    ``fichiers_liste`` is the file map as given, ``fichiers_raw`` the sibling
    list; the file count counts files, not dictionary keys."""
    from paraspark import schemas as S
    c = F.from_json(F.col(card_json) if isinstance(card_json, str) else card_json, S.CARD_SCHEMA)
    empty = F.array().cast("array<string>")
    listed = F.coalesce(c["files"], F.create_map().cast("map<string,map<string,array<string>>>"))
    files = F.flatten(F.transform(F.map_values(listed), lambda m: F.flatten(F.map_values(m))))
    return F.struct(
        c["id"].alias("nom"), c["author"].alias("auteur"),
        F.coalesce(c["description"], F.lit("")).alias("description"),
        c["cardData"]["license"].alias("licence"), c["lastModified"].alias("mis_a_jour"),
        F.coalesce(c["gated"], F.lit(False)).alias("acces_restreint"),
        F.coalesce(c["disabled"], F.lit(False)).alias("desactive"),
        F.coalesce(c["downloads"], F.lit(0).cast("long")).alias("telechargements"),
        F.coalesce(c["likes"], F.lit(0).cast("long")).alias("likes"),
        F.coalesce(c["tags"], empty).alias("tags"),
        F.coalesce(c["cardData"]["metrics"], empty).alias("metriques"),
        F.coalesce(c["cardData"]["task_categories"], empty).alias("taches"),
        F.coalesce(c["cardData"]["size_categories"], empty).alias("taille"),
        F.lit("Parquet").alias("format"),
        F.size(files).alias("fichiers_nombre"),
        listed.alias("fichiers_liste"),
        F.coalesce(c["siblings"], F.array().cast("array<struct<rfilename:string>>")).alias("fichiers_raw"),
    )
