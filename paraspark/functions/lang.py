"""Language-code functions (Column -> Column).

Lookup tables are tiny and fixed, so they compile to CASE expressions inside
generated code instead of joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paraspark import schemas as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c, table: dict, default=None) -> Column:
    """Literal dictionary lookup; ``default`` (a Column) on a miss, else null."""
    col = _c(c)
    out = None
    for k, v in table.items():
        out = (F.when(col == F.lit(k), F.lit(v)) if out is None
               else out.when(col == F.lit(k), F.lit(v)))
    if out is None:
        return default if default is not None else F.lit(None).cast("string")
    return out.otherwise(default) if default is not None else out


def normalize_lang(c) -> Column:
    """Lower-case, then alias (darija -> dr), else unchanged."""
    low = F.lower(_c(c))
    return lookup(low, S.LANGUAGE_ALIAS, low)


def split_direction(c) -> Column:
    """``src_tgt`` -> [src, tgt]; any other arity raises, like the reference."""
    parts = F.split(_c(c), "_", -1)
    return F.when(F.size(parts) == 2, parts).otherwise(
        F.raise_error(F.concat(F.lit("direction must have two parts: "), F.coalesce(_c(c), F.lit("NULL")))))


def model_code(c) -> Column:
    """C11: short code -> model language code (null when unknown)."""
    return lookup(c, S.MODEL_LANG_CODE)


def is_exportable(src_lang, tgt_lang, src_text, tgt_text) -> Column:
    """Both codes known and both texts non-empty."""
    known = list(S.MODEL_LANG_CODE)
    return (_c(src_lang).isin(known) & _c(tgt_lang).isin(known)
            & F.coalesce(F.length(_c(src_text)) > 0, F.lit(False))
            & F.coalesce(F.length(_c(tgt_text)) > 0, F.lit(False)))


def translation_map(src_lang, src_text, tgt_lang, tgt_text) -> Column:
    """``{code(src): src_text, code(tgt): tgt_text}``; the later value wins
    when both codes are equal (no session-level map-key policy needed)."""
    ks, kt = model_code(src_lang), model_code(tgt_lang)
    return F.when(ks == kt, F.create_map(kt, _c(tgt_text))).otherwise(
        F.create_map(ks, _c(src_text), kt, _c(tgt_text)))


def available_langs(translation) -> Column:
    """Codes whose value is present, whatever they are, in alphabetical order
    (the order a JSON reader gives the keys of a union of objects)."""
    return F.array_sort(F.map_keys(F.map_filter(_c(translation), lambda k, v: v.isNotNull())))


def infer_direction(translation, source: str = S.TRAIN_SOURCE_LANG,
                    target: str = S.TRAIN_TARGET_LANG) -> Column:
    """(src_lang, tgt_lang) struct; a null side means fewer than two
    languages are available (the row is rejected)."""
    langs = available_langs(translation)
    has_s = F.array_contains(langs, F.lit(source))
    has_t = F.array_contains(langs, F.lit(target))
    other_than_t = F.get(F.filter(langs, lambda k: k != F.lit(target)), 0)
    other_than_s = F.get(F.filter(langs, lambda k: k != F.lit(source)), 0)
    src = (F.when(has_s & has_t, F.lit(source))
           .when(has_t, other_than_t)
           .when(has_s, F.lit(source))
           .otherwise(F.get(langs, 0)))
    tgt = (F.when(has_s & has_t, F.lit(target))
           .when(has_t, F.lit(target))
           .when(has_s, other_than_s)
           .otherwise(F.get(langs, 1)))
    ok = src.isNotNull() & tgt.isNotNull()
    return F.struct(F.when(ok, src).alias("src_lang"), F.when(ok, tgt).alias("tgt_lang"))
