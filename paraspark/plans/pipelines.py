"""Composed plans: chat mixture -> pairs -> canonical table -> language-pair report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.functions import chat as C
from paraspark.functions import lang as L
from paraspark.functions import text as T
from paraspark.operators import dialogue as D


def keep_directions(df: DataFrame, directions=None) -> DataFrame:
    """Allow-list on ``direction`` (NULL is dropped); pushed into the scan."""
    return df.filter(F.col("direction").isin(list(directions or S.KEPT_DIRECTIONS)))


def chat_to_pairs(raw: DataFrame, mode: str = T.NATIVE, fallback: str | None = None) -> DataFrame:
    """Scan shape -> (dataset, id, direction, pairs, problem), one row per sample.

    ``mode='native'`` expects ``messages`` as ARRAY<STRUCT>; ``'row_repr'``
    expects the stringified list (parsed with E1, rules applied verbatim).
    """
    cols = ["dataset", "id", "direction"] + ([fallback] if fallback else [])
    kept = keep_directions(raw)
    if mode == T.ROW_REPR:
        staged = kept.select(*cols, C.parse_row_repr("messages").alias("_msgs"),
                             F.col("messages").alias("_text"))
        with_p = C.add_pairs(staged, "_msgs", mode, fallback, "_text")
    else:
        staged = kept.select(*cols, F.col("messages").alias("_msgs"))
        with_p = C.add_pairs(staged, "_msgs", mode, fallback)
    return with_p.select("dataset", "id", "direction", "pairs",
                         C.has_no_pairs("pairs").alias("problem"))


def flatten_pairs(df: DataFrame) -> DataFrame:
    """E7 + C9/C10: one row per pair with normalised codes, order kept in ``pos``."""
    parts = L.split_direction("direction")
    # explode_outer + filter keeps the optimizer from re-deriving the array in
    # an inferred size(pairs) > 0 filter below the generator
    x = (df.select("id", parts.alias("dir"), F.posexplode_outer("pairs").alias("pos", "pair"))
         .filter(F.col("pos").isNotNull()))
    return x.select(
        "id", "pos",
        L.normalize_lang(F.col("dir")[0]).alias("source_lang"),
        F.col("pair.texte_cible").alias("source_text"),
        L.normalize_lang(F.col("dir")[1]).alias("target_lang"),
        F.col("pair.traduction").alias("target_text"),
    )


def flat_pairs_long(turns: DataFrame) -> DataFrame:
    """C1, E4, E7 and C9/C10 over turn-per-row samples (``id, direction, turn,
    role, content``): as ``flatten_pairs(chat_to_pairs(...))``, a conversation
    of any length."""
    pairs = D.dispatch_long(keep_directions(turns), ["id", "direction"])
    parts = L.split_direction("direction")
    return pairs.select(
        "id", "pos", L.normalize_lang(parts[0]).alias("source_lang"), F.col("texte_cible").alias("source_text"),
        L.normalize_lang(parts[1]).alias("target_lang"), F.col("traduction").alias("target_text"))


def exportable(df: DataFrame) -> DataFrame:
    """C6 filter."""
    return df.filter(L.is_exportable("source_lang", "target_lang", "source_text", "target_text"))


def unique_pairs(df: DataFrame) -> DataFrame:
    """exact dedupe on the four canonical columns (NULLs equal).

    A hash aggregate with a map-side partial step: a key that holds a third
    of the rows collapses before the shuffle.
    """
    return df.select(*S.PAIR_COLUMNS).dropDuplicates(S.PAIR_COLUMNS)


def pairs_per_language_pair(df: DataFrame) -> DataFrame:
    """Count per (source_lang, target_lang), largest first."""
    return (df.groupBy("source_lang", "target_lang").agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.desc("total"), "source_lang", "target_lang"))


def flagship(raw: DataFrame, mode: str = T.NATIVE) -> DataFrame:
    """Chat mixture (one row per conversation) -> cleaned unique pairs per language pair."""
    return report(flatten_pairs(chat_to_pairs(raw, mode)))


def report(pairs: DataFrame) -> DataFrame:
    """Exportable unique pairs per language pair."""
    return pairs_per_language_pair(unique_pairs(exportable(pairs)))
