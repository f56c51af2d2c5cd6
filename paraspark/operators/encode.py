"""Model-input preparation: fixed-length id sequences over a corpus
vocabulary (M1) and the truncation report (M2).

Tokens are whitespace tokens. The vocabulary is ranked by (count desc,
token) with the distributed dense numbering (no single-partition window).
Natural text is Zipf-distributed, so the lookup is split by rank: the
``HEAVY`` most frequent tokens come as one broadcast table of bounded size, and
only occurrences of the other tokens, none of which is more than one in
``HEAVY`` of all, meet the rest of the vocabulary by the token. Only the first ``seq_len`` tokens of a text are
looked up, so a row never regroups more than ``seq_len`` ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.functions import text as T
from paraspark.operators.ranking import with_row_index

PAD_ID = 0
#: Tokens of the broadcast table and their bytes at most (4 MB in all).
HEAVY, HEAVY_BYTES = 1 << 16, 64


def whitespace_tokens(c) -> Column:
    """Whitespace tokens (str.split() semantics)."""
    return T.ws_tokens(c)


def vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, id) with id 1.. by (count desc, token)."""
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("freq"))
    # the vocabulary is an aggregate over every token: materialise it once
    return with_row_index(counts, [("freq", False), token], "tok_id").select(
        token, "tok_id", "freq")


def encode(df: DataFrame, key: str, text_cols: list[str], seq_len: int = S.SEQ_LEN) -> DataFrame:
    """(key, <col>_ids ...) truncated to ``seq_len`` and right-padded with PAD_ID.

    ``key`` must be unique per row. The texts are tokenised once for the
    vocabulary and once for the ``lookup``, where each row becomes one (field,
    pos, token) row per head token plus one marker row, so a row without tokens
    comes back without a join to the input; the ids regroup by key (at most
    ``seq_len`` per field).
    """
    tok_names = [f"_t{i}" for i in range(len(text_cols))]
    # a NULL text has no tokens (an empty array: concat would turn the whole
    # row's token list NULL)
    none = F.array().cast("array<string>")
    toks = df.select(key, *[F.coalesce(whitespace_tokens(c), none).alias(t) for c, t in zip(text_cols, tok_names)])
    every = toks.select(F.explode(F.concat(*[F.col(t) for t in tok_names])).alias("token"))
    vocab = vocabulary(every)

    def tagged(f: int):
        return lambda x, i: F.struct(F.lit(f).alias("f"), i.alias("pos"), x.alias("token"))

    item = "struct<f:int,pos:int,token:string>"
    marker = F.array(F.struct(F.lit(-1).alias("f"), F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("token")))
    heads = [F.transform(F.slice(F.col(t), 1, seq_len), tagged(f)) for f, t in enumerate(tok_names)]
    exploded = toks.select(key, F.inline(F.concat(marker, *heads).cast(f"array<{item}>")))
    ids = lookup(exploded, vocab, key)
    per_key = ids.groupBy(key).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("f") == f, F.struct("pos", "tok_id")))).alias(f"_s{f}")
        for f in range(len(text_cols))])
    pad = F.array_repeat(F.lit(PAD_ID).cast("long"), seq_len)
    cols = [F.slice(F.concat(F.transform(F.col(f"_s{f}"), lambda x: x["tok_id"]), pad), 1, seq_len).alias(f"{c}_ids")
            for f, c in enumerate(text_cols)]
    return per_key.select(key, *cols)


def lookup(rows: DataFrame, vocab: DataFrame, key: str, token: str = "token") -> DataFrame:
    """``rows`` with the ``tok_id`` of their token (NULL for a NULL token).

    ``vocab`` ranks by frequency, so its first ``HEAVY`` ids are the heavy
    hitters; those of at most ``HEAVY_BYTES`` bytes are broadcast. Rows they
    answer go through the shuffle under their row's own key, so that no
    frequent token is a join key; a longer token joins like the rare ones."""
    heavy = (F.col("tok_id") <= HEAVY) & (F.octet_length(token) <= HEAVY_BYTES)
    top = F.broadcast(vocab.filter(heavy).select(F.col(token).alias("_top"), F.col("tok_id").alias("_heavy")))
    at = rows.join(top, F.col(token) == F.col("_top"), "left").drop("_top")
    rare = F.col("_heavy").isNull() & F.col(token).isNotNull()
    at = at.withColumn("_by", F.when(rare, F.col(token)).otherwise(F.concat(F.lit("\u0000"), F.col(key).cast("string"))))
    rest = vocab.filter(~heavy).select(F.col(token).alias("_by"), "tok_id")
    found = F.coalesce("_heavy", F.when(F.col(token).isNotNull(), F.col("tok_id"))).alias("tok_id")
    return at.join(rest, "_by", "left").select(*rows.columns, found)


def truncation_report(df: DataFrame, lang: str, texts: list[str], seq_len: int = S.SEQ_LEN) -> DataFrame:
    """M2: rows, and rows cut at ``seq_len`` tokens on each side, per language."""
    def cut(c):
        return F.sum(F.when(F.size(whitespace_tokens(c)) > seq_len, 1).otherwise(0)).cast("long").alias(f"truncated_{c}")
    return df.groupBy(lang).agg(F.count(F.lit(1)).alias("rows"), *[cut(c) for c in texts])
