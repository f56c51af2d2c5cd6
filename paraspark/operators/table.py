"""Translation-table operators (DataFrame -> DataFrame): filters, CRUD change
sets, validation and numbering. Change sets never mutate their input: each
returns a new DataFrame, written by the caller to a new location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.functions import text as T
from paraspark.operators.digest import DIGEST, key_digest, repeated_keys
from paraspark.operators.ranking import with_row_index

FIELDS = S.PAIR_COLUMNS


# ---------------------------------------------------------------- C: filters

def filter_langs(df: DataFrame, source_lang: str | None = None,
                 target_lang: str | None = None) -> DataFrame:
    """Each given language restricts; an absent one adds no predicate."""
    out = df
    if source_lang is not None:
        out = out.filter(F.col("source_lang") == F.lit(source_lang))
    if target_lang is not None:
        out = out.filter(F.col("target_lang") == F.lit(target_lang))
    return out


def get_by_id(df: DataFrame, id_value: int) -> DataFrame:
    """0 or 1 row (min/max statistics on ``id`` prune Parquet row groups)."""
    return df.filter(F.col("id") == F.lit(id_value))


def starts_with_prefix(prefix: str = S.TEST_PREFIX) -> Column:
    """C4 predicate (LIKE 'prefix%' on either text), NULL-aware."""
    return F.coalesce(F.startswith(F.col("source_text"), F.lit(prefix))
                      | F.startswith(F.col("target_text"), F.lit(prefix)), F.lit(False))


def delete_prefixed(df: DataFrame, prefix: str = S.TEST_PREFIX) -> DataFrame:
    """C4: rows left after removing those whose either text starts with ``prefix``."""
    return df.filter(~starts_with_prefix(prefix))


def missing_target_default(c, sentinel: str = S.MISSING_TARGET) -> Column:
    """Null or empty -> sentinel."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(col, F.lit("")) == F.lit(""), F.lit(sentinel)).otherwise(col)


def first_n(df: DataFrame, n: int, order_cols: list) -> DataFrame:
    """First ``n`` rows by a stated order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order_cols).limit(n)


def text_search(df: DataFrame, needle: str, source_lang: str | None = None,
                target_lang: str | None = None) -> DataFrame:
    """C14: case-insensitive substring search on either text, plus C2."""
    pat = F.lower(F.lit(needle))
    hit = F.coalesce(F.contains(F.lower("source_text"), pat) | F.contains(F.lower("target_text"), pat),
                     F.lit(False))
    return filter_langs(df.filter(hit), source_lang, target_lang)


# ------------------------------------------------------------- G: change sets

def resume_pending(phrases: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """G1: phrases not yet processed; a phrase repeated in the input once.

    Both sides are tagged and unioned, then grouped once by the key: a key
    is pending when it came from ``phrases`` and never from ``existing``.
    One shuffle, and repeats of a hot key collapse in the map-side partial
    aggregate on both sides. Keys compare like set membership (NULL equals
    NULL), as in the seen-set being replaced.
    """
    tagged = (phrases.select(*keys, F.lit(True).alias("_p"), F.lit(False).alias("_e"))
              .unionByName(existing.select(*keys, F.lit(False).alias("_p"), F.lit(True).alias("_e"))))
    return (tagged.groupBy(*keys).agg(F.max("_p").alias("_p"), F.max("_e").alias("_e"))
            .filter(F.col("_p") & ~F.col("_e")).select(*keys))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], winner: str | None = None) -> DataFrame:
    """Append rows of ``new`` whose key is absent; existing rows untouched.

    Of new rows with the same key one goes in: the smallest by ``winner`` (a
    column) and then by all columns, so the key stays unique. Keys with a NULL
    never match (SQL UNIQUE semantics): such rows are all inserted. Keys meet by
    digest: of the old rows 32 bytes each are shuffled, never their texts."""
    rest = [c for c in old.columns if c not in keys]
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    order = F.struct(*([winner] if winner else []), *[c for c in rest if c != winner]) if rest else F.lit(0)
    once = (new.filter(~has_null).withColumn(DIGEST, key_digest(keys)).groupBy(DIGEST)
            .agg(F.min(F.struct(order.alias("_order"), F.struct(*keys).alias("_keys"))).alias("_row"))
            .select(DIGEST, *[F.col("_row._keys")[k].alias(k) for k in keys], *[F.col(f"_row._order.{c}").alias(c) for c in rest]))
    added = once.join(old.select(key_digest(keys).alias(DIGEST)), DIGEST, "left_anti").drop(DIGEST)
    return (old.unionByName(added.select(*old.columns))
            .unionByName(new.filter(has_null).select(*old.columns)))


def update_by_key(table: DataFrame, changes: DataFrame, key: str = "id",
                  fields: list[str] = FIELDS, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace all ``fields`` of rows whose key is in ``changes``.

    Of several changes of one key the last by ``order`` (a column), then the
    largest by the fields, counts. Returns (new table, updated rows); unknown
    keys in ``changes`` are ignored.
    """
    last = F.max_by(F.struct(*fields), F.struct(*([order] if order else []), *fields))
    ch = (changes.groupBy(key).agg(last.alias("_c"))
          .select(key, *[F.col(f"_c.{f}").alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit")))
    j = table.join(ch, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    new_table = j.select(*[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
                           if c in fields else F.col(c) for c in table.columns])
    updated = table.select(key).join(ch, key, "inner").select(
        key, *[F.col(f"_new_{f}").alias(f) for f in fields])
    return new_table, updated


def delete_by_key(table: DataFrame, keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(remaining rows, deleted rows)."""
    k = keys.select(key)
    return table.join(k, key, "left_anti"), table.join(k, key, "left_semi")


def required_present(fields: list[str] = FIELDS) -> Column:
    """Every required field is present."""
    cond = F.lit(True)
    for f in fields:
        cond = cond & F.col(f).isNotNull()
    return cond


def create_rows(table: DataFrame, new_rows: DataFrame, order_cols: list,
                key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Validate (J2 + J1), number after the current maximum id (H3),
    append. Returns (new table, created rows)."""
    valid = with_violations(new_rows.filter(required_present())).filter(F.size("violations") == 0)
    # one scalar to the driver: the current maximum key
    top = table.agg(F.max(key)).first()[0] or 0
    created = with_row_index(valid, order_cols, "_idx").select(
        (F.col("_idx") + F.lit(top)).alias(key), *FIELDS)
    return table.unionByName(created.select(*table.columns)), created


def duplicate_keys(df: DataFrame, keys: list[str] = FIELDS, row_key: str | None = None) -> DataFrame:
    """Keys that occur more than once among rows without NULLs (must be
    empty); with a unique ``row_key`` no text is shuffled."""
    return repeated_keys(df.na.drop(subset=keys), keys, row_key=row_key)


# -------------------------------------------------------------- H: ordering

def newest_first(df: DataFrame, key: str = "id") -> DataFrame:
    """H1."""
    return df.orderBy(F.desc(key))


# ------------------------------------------------------------ J: validation

RULES = ["source_lang", "target_lang", "source_text", "target_text", "same_language"]


def violations(source_lang="source_lang", source_text="source_text", target_lang="target_lang",
               target_text="target_text") -> Column:
    """Names of the violated rules, in a fixed order."""
    sl, st, tl, tt = (F.col(x) if isinstance(x, str) else x
                      for x in (source_lang, source_text, target_lang, target_text))

    def bad_lang(c):
        return ~F.coalesce(c.isin(S.TABLE_LANGS), F.lit(False))

    def bad_text(c):
        n = F.length(c)
        return ~F.coalesce((n >= S.TEXT_MIN_CHARS) & (n <= S.TEXT_MAX_CHARS), F.lit(False))

    same = ~bad_lang(sl) & ~bad_lang(tl) & (sl == tl)
    checks = [bad_lang(sl), bad_lang(tl), bad_text(st), bad_text(tt), same]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in zip(checks, RULES)]))


def with_violations(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", violations())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J1 routing: (valid, rejected-with-violations)."""
    v = with_violations(df)
    return v.filter(F.size("violations") == 0).drop("violations"), v.filter(F.size("violations") > 0)


def violation_counts(df: DataFrame) -> DataFrame:
    """Rows per violated rule."""
    return (with_violations(df).select(F.explode("violations").alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("rows")))


def normalise_langs(df: DataFrame) -> DataFrame:
    from paraspark.functions.lang import normalize_lang
    return (df.withColumn("source_lang", normalize_lang("source_lang"))
            .withColumn("target_lang", normalize_lang("target_lang")))


def blank_free(c) -> Column:
    return T.non_blank(c)
