"""Chat formatting by perspective rotation.

Every participant of a dialogue gets the dialogue rendered from its own side:
its turns are the assistant's, everyone else's are a user's with the speaker's
name, system turns stay system turns. The mask lists the spans to train on:
the text and end mark of the assistant's turns.

A rendering comes in parts of ``PART_TURNS`` consecutive turn numbers, and in
pieces of at most ``PIECE_ROWS`` turns where more rows share those numbers,
each with its place in the whole, so that a very long dialogue is never
gathered into one row; pieces put one after the other are the rendering.
Built-in functions only.

Defined results: a NULL text is an empty turn, a NULL role speaks as
``unknown``; rows with a NULL conversation or turn belong to no dialogue; rows
that share a turn follow each other by role and text, identical rows count
once; a dialogue of system turns only has no perspective; the marks' opening
inside a text is broken up so that a text cannot forge a turn; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraspark.llm.common import table
from paraspark.plans.registry import register

PART_TURNS, PIECE_ROWS = 256, 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
FORGED, BROKEN = "<|im_", "< |im_"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``conv_id, speaker, part, piece, start, text, mask, n_chars, n_trained``:
    one row per participant and piece of a part; ``mask`` is ``first:length``
    spans in the row's text, ``start`` the characters of the rows before."""
    def safe(c):
        return F.replace(c, F.lit(FORGED), F.lit(BROKEN))
    by = F.translate(safe(F.coalesce("role", F.lit("unknown"))), "\n\r", "  ")
    t = (turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
         .select("conv_id", F.col("turn").cast("long").alias("turn"), by.alias("by"), safe(F.coalesce("text", F.lit(""))).alias("said")).distinct()
         .withColumn("part", F.floor(F.col("turn") / part_turns)))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "by", "said"))
    t = t.withColumn("piece", F.floor((place - 1) / piece_rows))
    sides = t.filter("by != 'system'").select("conv_id", F.col("by").alias("speaker")).distinct()
    own = F.col("by") == F.col("speaker")
    head = F.concat(F.lit(OPEN), F.when(own, "assistant").when(F.col("by") == "system", "system")
                    .otherwise(F.concat(F.lit("user name="), "by")), F.lit("\n"))
    tail = F.concat("said", F.lit(CLOSE))
    parts = (t.join(sides, "conv_id")
             .select("conv_id", "speaker", "part", "piece",
                     F.struct("turn", "by", "said", head.alias("head"), tail.alias("tail"), own.alias("own")).alias("s"))
             .groupBy("conv_id", "speaker", "part", "piece").agg(F.sort_array(F.collect_list("s")).alias("s")))
    done = F.expr(f"""aggregate(s, named_struct('at', 0L, 'trained', 0L, 'spans', cast(array() AS array<string>)), (a, x) -> named_struct(
        'at', a.at + length(x.head) + length(x.tail) + 1,
        'trained', a.trained + if(x.own, length(x.tail), 0),
        'spans', if(x.own, concat(a.spans, array(concat(a.at + length(x.head), ':', length(x.tail)))), a.spans)))""")
    rows = parts.select("conv_id", "speaker", "part", "piece", F.expr("concat_ws('', transform(s, x -> concat(x.head, x.tail, '\n')))").alias("text"), done.alias("d"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("conv_id", "speaker", "part", "piece", F.coalesce(F.sum("d.at").over(before), F.lit(0)).alias("start"), "text",
                       F.concat_ws(",", "d.spans").alias("mask"), F.col("d.at").alias("n_chars"), F.col("d.trained").alias("n_trained"))


OP5_SQL = f"""WITH t0 AS (SELECT DISTINCT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '{FORGED}', '{BROKEN}'), chr(10) || chr(13), '  ') AS by_, replace(coalesce(text, ''), '{FORGED}', '{BROKEN}') AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT *, floor(turn / {PART_TURNS})::BIGINT AS part,
  (row_number() OVER (PARTITION BY conv_id, floor(turn / {PART_TURNS}) ORDER BY turn, by_, said) - 1) // {PIECE_ROWS} AS piece FROM t0),
w AS (SELECT DISTINCT conv_id, by_ AS speaker FROM t WHERE by_ <> 'system'),
s AS (SELECT conv_id, speaker, part, piece, turn, by_, said, by_ = speaker AS own,
  '{OPEN}' || CASE WHEN by_ = speaker THEN 'assistant' WHEN by_ = 'system' THEN 'system' ELSE 'user name=' || by_ END || chr(10) AS head,
  said || '{CLOSE}' AS tail FROM t JOIN w USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY turn, by_, said
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM s),
p AS (SELECT conv_id, speaker, part, piece, string_agg(head || tail || chr(10), '' ORDER BY turn, by_, said) AS text,
  coalesce(string_agg(CASE WHEN own THEN (at_ + length(head))::BIGINT || ':' || length(tail) END, ',' ORDER BY turn, by_, said), '') AS mask,
  sum(length(head) + length(tail) + 1)::BIGINT AS n_chars, sum(CASE WHEN own THEN length(tail) ELSE 0 END)::BIGINT AS n_trained
  FROM o GROUP BY conv_id, speaker, part, piece)
SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY conv_id, speaker ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p"""


@register("op5_perspective_rotation", OP5_SQL)
def op5_perspective_rotation(spark, d):
    """Every conversation from the side of each participant."""
    return rotate(table(spark, d, "conversations"))
