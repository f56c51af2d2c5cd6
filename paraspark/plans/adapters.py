"""Adapters: driver tables -> inputs shaped like the reference's data.

The driver tables hold no translation pairs, so every query derives them
with the arithmetic below (the oracle SQL derives them identically). All
adapters are narrow per-row expressions except ``raw_mix``, which puts the
turns of a conversation into one row (the reference's input is one row per
conversation with its whole message list) and is read only where that list
itself is the operator's input; all else reads ``sample_turns`` and
``marked_turns``, where a conversation may be of any length
(``operators/dialogue.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.operators.partitioning import spread

# Fixed adapter parameters (shared with the oracle SQL).
# user turns of these conversations get another role, so that they hold no pair
NO_USER_EVERY, NO_USER_REST = 13, 4
# turns below this number are joined into the marked first message of a sample
MARK_TURNS = 64
DIRECTIONS_BY_MOD5 = ["en_dr", "fr_dr", "dr_fr", "dr_en", "ar_dr"]
DIRTY_PREFIX = "ترجم من الفرنساوية للدارجة: "
SOURCE_LANGS_BY_MOD4 = ["fr", "EN", "darija", "dr"]
TARGET_LANGS_BY_MOD4 = ["dr", "Darija", "fr", "en"]
# the "translation" of a text is the whole text with ASCII letters upper-cased
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# tables whose rows carry long texts, with a key that is unique per row: where
# heavy per-row text work follows directly, a thin scan is spread by that key
TEXT_TABLES = {"documents": ["doc_id"], "pages": ["page_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table in front of heavy per-row work (splitting, cleaning,
    tokenising, HTML): a scan of fewer splits than cores is spread first."""
    return spread(table(spark, sf_dir, name), unique_key=TEXT_TABLES[name])


def _pick(values: list, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def dirty_text(text: Column, conv_id: Column, role: Column) -> Column:
    """' the ' -> ' ' NBSP 'the\\ '; instruction prefix on user turns of every third conversation."""
    out = F.replace(text, F.lit(" the "), F.lit(" \u00a0the\\ "))
    return F.when((conv_id % 3 == 0) & (role == F.lit("user")),
                  F.concat(F.lit(DIRTY_PREFIX), out)).otherwise(out)


def adapted_role(conv_id: Column, turn: Column, role: Column) -> Column:
    """Some assistant turns are relabelled ``user`` so that consecutive users
    occur (the driver data has none), and the user turns of some conversations
    get another role, so that conversations without a pair occur; every turn
    is kept."""
    return F.when((role == F.lit("user")) & (conv_id % NO_USER_EVERY == NO_USER_REST), F.lit("narrator")).when(
        (role == F.lit("assistant")) & ((conv_id + turn) % 5 == 3), F.lit("user")).otherwise(role)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form turns of every conversation, one row per turn."""
    c = table(spark, sf_dir, "conversations")
    r = c.select("conv_id", "turn", "text",
                 adapted_role(F.col("conv_id"), F.col("turn"), F.col("role")).alias("role"))
    return r.select("conv_id", "turn", "role",
                    dirty_text(F.col("text"), F.col("conv_id"), F.col("role")).alias("content"))


def _sample_columns() -> list[Column]:
    return [F.col("conv_id").cast("string").alias("id"),
            F.concat(F.lit("src"), (F.col("conv_id") % 3).cast("string")).alias("dataset"),
            _pick(DIRECTIONS_BY_MOD5, F.col("conv_id") % 5).alias("direction")]


def raw_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, id, messages, direction, metadata): one row per conversation,
    for the operators whose input is the message list itself (E1, E3 on arrays,
    E10, the chat files)."""
    t = turns(spark, sf_dir)
    g = (t.groupBy("conv_id")
         .agg(F.sort_array(F.collect_list(F.struct("turn", "content", "role"))).alias("m")))
    sample_id, dataset, direction = _sample_columns()
    return g.select(
        dataset, sample_id,
        F.transform("m", lambda x: F.struct(x["content"].alias("content"), x["role"].alias("role")))
        .alias("messages"),
        direction,
        F.lit(None).cast("string").alias("metadata"),
    )


def _py_repr(c: Column) -> Column:
    """Python ``repr`` of a string: quote choice and the escapes that occur."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    body = F.replace(body, F.lit("\n"), F.lit("\\n"))
    body = F.replace(body, F.lit("\t"), F.lit("\\t"))
    body = F.replace(body, F.lit("\u00a0"), F.lit("\\xa0"))
    dq = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(dq, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def row_repr(messages: Column) -> Column:
    """Messages rendered as ``[Row(content='…', role='…'), …]`` text."""
    items = F.transform(messages, lambda x: F.concat(
        F.lit("Row(content="), _py_repr(x["content"]), F.lit(", role="), _py_repr(x["role"]), F.lit(")")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def raw_mix_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV-era shape: ``messages`` as stringified text."""
    r = raw_mix(spark, sf_dir)
    return r.withColumn("messages", row_repr(F.col("messages")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, dataset, direction): one row per conversation, without messages."""
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(*_sample_columns())


def sample_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, id, dataset, direction, turn, role, content): one row per turn."""
    return turns(spark, sf_dir).select("conv_id", *_sample_columns(), "turn", "role", "content")


def marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed messages for the dispatch operators, one row per message
    (``turn`` gives their order).

    Even conversations open with one ``user`` message that holds their
    user/assistant turns of the first ``MARK_TURNS`` turn numbers, joined by
    markers, except the last of these when it is an assistant's, which follows
    as a message of its own; turns of later numbers stay as they are. Odd
    conversations, and those without such turns, keep plain turns.
    """
    t = sample_turns(spark, sf_dir)
    about = ["conv_id", "id", "dataset", "direction"]
    even = F.col("conv_id") % 2 == 0
    early = F.col("turn") < MARK_TURNS
    spoken = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    ua = F.col("ua")
    n = F.size(ua)
    # at most MARK_TURNS turns of a conversation meet in one row
    heads = t.filter(even & early & spoken).groupBy(*about).agg(F.sort_array(F.collect_list(F.struct("turn", "content", "role"))).alias("ua"))
    ends = F.get(ua, n - 1)["role"] == F.lit("assistant")
    body = F.when(ends, F.slice(ua, 1, F.greatest(n - 1, F.lit(0)))).otherwise(ua)
    joined = F.array_join(F.transform(body, lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>"), x["content"])), "")
    # the marked string starts without its leading user marker, like the reference's examples
    joined = F.regexp_replace(joined, "^<\\|user\\|>", "")

    def message(turn: int, role: Column, content: Column) -> Column:
        return F.struct(F.lit(turn).cast("long").alias("turn"), role.alias("role"), content.alias("content"))
    last = F.get(ua, n - 1)
    opening = F.concat(F.array(message(0, F.lit("user"), joined)), F.when(ends, F.array(message(1, last["role"], last["content"]))).otherwise(F.array()))
    merged = heads.select(*about, F.inline(opening))
    other = t.filter(even & (~early | ~spoken)).join(heads.select("conv_id", F.lit(True).alias("_merged")), "conv_id", "left")
    other = other.filter(~early | F.col("_merged").isNull())
    other = other.select(*about, (F.col("turn") + F.when(early, 0).otherwise(2)).alias("turn"), "role", "content")
    return t.filter(~even).select(*about, "turn", "role", "content").unionByName(other).unionByName(merged)


def target_of(text: Column) -> Column:
    """Whole-text stand-in translation: ASCII letters upper-cased."""
    return F.translate(text, ASCII_LOWER, ASCII_UPPER)


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_lang, source_text, target_lang, target_text) from documents
    (every row's whole text is rewritten for the target, so the scan is spread)."""
    d = texts(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    return d.select(
        F.col("doc_id").alias("id"),
        _pick(SOURCE_LANGS_BY_MOD4, k).alias("source_lang"),
        F.col("text").alias("source_text"),
        _pick(TARGET_LANGS_BY_MOD4, k).alias("target_lang"),
        target_of(F.col("text")).alias("target_text"),
    )


def hyp_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, system, hyp, ref): assistant turn vs the user turn right before it
    (system A); system B drops every third whitespace token of A's hypothesis."""
    c = table(spark, sf_dir, "conversations")
    a = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("hyp"))
    u = c.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                 F.col("text").alias("ref"))
    j = a.join(u, ["conv_id", "turn"])
    toks = F.split(F.btrim(F.col("hyp"), F.lit(S.WS_CHARS)), S.WS_CLASS + "+")
    dropped = F.array_join(F.filter(toks, lambda t, i: i % 3 != 2), " ")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return j.select(key.alias("key"), "hyp", "ref", dropped.alias("hyp_b"))


def epoch_millis(df: DataFrame, col: str) -> Column:
    """Milliseconds since the epoch, whatever the session time zone: a
    timestamp without time zone is read as UTC wall time (its difference from
    the epoch), a zoned timestamp is already an instant."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))
    return F.unix_millis(F.col(col).cast("timestamp"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, metric, ts_ms, value, step) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_type").alias("metric"),
        epoch_millis(e, "ts").alias("ts_ms"),
        F.col("value"),
        F.col("event_id").alias("step"),
    )
