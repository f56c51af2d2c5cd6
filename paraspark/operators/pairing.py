"""E3 long form: greedy user -> assistant pairing over turn-per-row data.

``functions.chat.greedy_pairs`` needs the messages of a conversation in one
row; this operator pairs turns where they lie, whatever a conversation's
length. Inside one conversation (``keys``), ordered by ``order``:

* the target of a ``user`` turn is the next turn's content when that turn is
  an ``assistant`` turn, else '';
* within each maximal run of consecutive ``user`` turns the 1st, 3rd, 5th ...
  are paired (the scan advances by two after a user turn either way); every
  other role just advances.

A conversation is cut into blocks of ``block`` order numbers, so one that
holds a large part of the table is many window groups. What a block needs from
the others is little: how many users directly precede it, how many pairs come
before, and the first turn after it. One row per block carries its length, its
leading and trailing runs of users and its first turn; a window over these
rows gives every block its entry state, and the block's own rows follow from
it. The cut never changes the result. ``operators.dialogue`` folds more
partials over the same blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def turn_rows(turns: DataFrame, keys: list[str], order: str, role: str, content: str, block: int) -> DataFrame:
    """Turns with their block, their place in it and in their run of users
    (as far as the block shows it), and the turn after them in the block.
    ``_key`` holds the keys as one value, which is never NULL: windows and the
    join back share one partitioning, and NULL keys are one conversation."""
    inside = Window.partitionBy("_key", "_blk").orderBy("_order")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # any other role, NULL included, ends a run of users
    is_user = F.coalesce(F.col(role) == F.lit("user"), F.lit(False))
    rows = turns.select(F.struct(*keys).alias("_key"), F.col(order).alias("_order"), F.col(role).alias("_role"), F.col(content).alias("_content"),
                        is_user.alias("_user"), F.floor(F.col(order) / block).alias("_blk"))
    rn = F.row_number().over(inside)
    rows = rows.select(
        "*", rn.alias("_rn"), F.lead(F.struct("_role", "_content")).over(inside).alias("_next"),
        F.coalesce(F.last(F.when(~F.col("_user"), rn), ignorenulls=True).over(upto), F.lit(0)).alias("_brk"))
    rows = rows.withColumn("_idx", F.col("_rn") - F.col("_brk"))
    leading = F.col("_user") & (F.col("_brk") == 0)
    later = F.col("_user") & (F.col("_brk") > 0) & (F.col("_idx") % 2 == 1)
    return rows.select("*", leading.alias("_leading"), later.alias("_later"),
                       F.count(F.when(leading, 1)).over(before).alias("_leading_before"),
                       F.count(F.when(later, 1)).over(before).alias("_later_before"))


def block_rows(rows: DataFrame, partials: list[Column] = ()) -> DataFrame:
    """One row per block with the state it starts from: ``_entry`` (parity of
    the users directly before it), ``_pairs`` in it, ``_pairs_before`` it, and
    ``_after``, the first turn of the next block; with ``partials`` of its rows."""
    blocks = rows.groupBy("_key", "_blk").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("_leading"), 1)).alias("_lead"),
        F.max("_brk").alias("_last_break"),
        F.count(F.when(F.col("_later"), 1)).alias("_later_pairs"),
        F.min_by(F.struct("_role", "_content"), "_order").alias("_first"), *partials)
    along = Window.partitionBy("_key").orderBy("_blk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # users directly before a block: the trailing run of the last block with a
    # break, and all rows of the blocks of users only that follow it
    whole = F.when(F.col("_lead") == F.col("_n"), F.col("_n")).otherwise(0)
    blocks = blocks.withColumn("_users_so_far", F.sum(whole).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.when(F.col("_lead") < F.col("_n"), F.col("_n") - F.col("_last_break") - F.col("_users_so_far"))
    blocks = blocks.withColumn("_entry", (F.coalesce(F.sum(whole).over(before), F.lit(0))
                                          + F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(0))) % 2)
    blocks = blocks.withColumn("_pairs", F.col("_later_pairs") + F.floor((F.col("_lead") + 1 - F.col("_entry")) / 2))
    return blocks.select(
        "*", F.coalesce(F.sum("_pairs").over(before), F.lit(0)).alias("_pairs_before"), F.lead("_first").over(along).alias("_after"))


def with_block_state(rows: DataFrame, blocks: DataFrame, state: list[str]) -> DataFrame:
    """``rows`` with the columns ``state`` of their block."""
    return rows.join(blocks.select("_key", "_blk", *state), ["_key", "_blk"])


def key_columns(keys: list[str]) -> list[Column]:
    return [F.col("_key")[k].alias(k) for k in keys]


def starts_pair() -> Column:
    """The row is a user turn that the greedy scan visits."""
    idx = F.col("_idx") + F.when(F.col("_brk") == 0, F.col("_entry")).otherwise(0)
    return F.col("_user") & (idx % 2 == 1)


def pair_position() -> Column:
    """Pairs of the conversation before the row's."""
    return (F.col("_pairs_before") + F.col("_later_before")
            + F.floor((F.col("_leading_before") + 1 - F.col("_entry")) / 2)).cast("long")


def answer() -> Column:
    """Content of the next turn when that is an assistant's, else ''."""
    nxt = F.coalesce("_next", "_after")
    return F.when(nxt["_role"] == F.lit("assistant"), nxt["_content"]).otherwise(F.lit(""))


def greedy_pairs_long(turns: DataFrame, keys: list[str], order: str = "turn", role: str = "role",
                      content: str = "content", block: int = BLOCK) -> DataFrame:
    """(keys..., pos, texte_cible, traduction): one row per extracted pair.
    ``order`` is an integer column, unique inside a conversation."""
    rows = turn_rows(turns, keys, order, role, content, block)
    rows = with_block_state(rows, block_rows(rows), ["_entry", "_pairs_before", "_after"])
    return rows.filter(starts_pair()).select(
        *key_columns(keys), pair_position().alias("pos"), F.col("_content").alias("texte_cible"), answer().alias("traduction"))
