"""Chat operators over turn-per-row data (E2, E4-E6, E8, E9, E11, E13; the
message-list metrics of F8-F11): no conversation is gathered into one row.

Every fact about a conversation is a fold over blocks of turns: counts, marker
sums and JSON lengths are sums, the first message and the last assistant
message are the extremes of an order, and the state of the greedy scan is that
of ``operators.pairing``. A block of ``block`` order numbers is one window
group and yields one small row; windows over these rows give each block what
it needs from the others (is the conversation marked, are its markers
balanced, how many pairs it has, the texts that complete the last pair), and
the pairs are built where the turns lie.

The array functions in ``functions.chat`` give the same pairs for inputs that
already come as one array per conversation. Defined results: a NULL role is no
user and no assistant, a NULL content cleans to NULL as there; a conversation
of any length, also of one turn, is handled alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.functions import chat as C
from paraspark.functions import text as T
from paraspark.operators import pairing as P


def _blocks_with_facts(rows: DataFrame, fallback: Column | None) -> DataFrame:
    """Blocks with the facts of their conversation: ``_marked``,
    ``_unmatched`` (one user marker more than assistant markers), ``_n_pairs``
    of the greedy scan; ``_head`` (the conversation's first block). The texts
    ``_outside`` and ``_fallback`` go only to the blocks that use them."""
    assistant = F.col("_role") == F.lit("assistant")
    blocks = P.block_rows(rows, [
        F.sum(C.count_marker("_content", S.USER_MARK)).alias("_users"),
        F.sum(C.count_marker("_content", S.ASSISTANT_MARK)).alias("_assistants"),
        F.max_by(F.when(assistant, F.struct("_content")), F.when(assistant, F.col("_order"))).alias("_last_assistant")])
    along = Window.partitionBy("_key").orderBy("_blk")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumn("_head", F.row_number().over(along) == 1)
    first = F.struct(F.col("_first._role").alias("role"), F.col("_first._content").alias("content"))
    blocks = blocks.select(
        "*", F.max(F.when(F.col("_head"), C.is_marked_first(F.array(first)))).over(whole).alias("_marked"),
        (F.sum("_users").over(whole) + 1 - F.sum("_assistants").over(whole) == 1).alias("_unmatched"),
        F.sum("_pairs").over(whole).alias("_n_pairs"),
        F.last("_last_assistant", ignorenulls=True).over(whole)["_content"].alias("_last_said"),
        F.first(first).over(whole).alias("_opening"))
    marked_head = F.col("_marked") & F.col("_head")
    ends = ~F.col("_marked") & (F.col("_pairs") > 0) & (F.col("_pairs_before") + F.col("_pairs") == F.col("_n_pairs"))
    filled = F.lit("") if fallback is None else T.clean_text(F.coalesce(fallback, F.lit("")))
    return blocks.withColumns({"_outside": F.when(marked_head, F.coalesce(T.clean_text(T.strip_ws(F.col("_last_said"))), F.lit(""))),
                               "_fallback": F.when(marked_head | ends, filled)})


OPENING = "_opening"


def opening_content() -> Column:
    """For ``fallback``: the content of the conversation's first message."""
    return F.col(OPENING)["content"]


def dispatch_long(turns: DataFrame, keys: list[str], order: str = "turn", role: str = "role", content: str = "content",
                  fallback: Column | None = None, mode: str = T.NATIVE, block: int = P.BLOCK) -> DataFrame:
    """E4 + E5 + E6: (keys..., marked, n_pairs, pos, texte_cible, traduction).

    A conversation whose first message is a ``user`` one with a marker gives
    the pairs of that message (E2), its last pair completed by the last
    assistant message of the conversation (E5); any other gives the greedy
    pairs (E3) of its messages cleaned by D6 and D5. Where the markers are
    unbalanced by one and the last target is still empty, ``fallback`` (a
    column over the conversation, see ``opening_content``; '' when absent),
    cleaned, completes it (E6).
    """
    rows = P.turn_rows(turns, keys, order, role, content, block)
    blocks = _blocks_with_facts(rows, fallback)
    rows = P.with_block_state(rows, blocks, ["_entry", "_pairs_before", "_after", "_head", "_marked", "_unmatched", "_n_pairs",
                                                   "_outside", "_fallback"])
    opens = F.col("_marked") & F.col("_head") & (F.col("_rn") == 1)
    rows = rows.filter(opens | (~F.col("_marked") & P.starts_pair()))

    def clean(c):
        return T.clean_text(T.drop_newlines(c, mode))

    one = F.array(F.struct(clean(F.col("_content")).alias("texte_cible"), clean(P.answer()).alias("traduction")))
    rows = rows.select("_key", "_marked", "_unmatched", "_n_pairs", "_outside", "_fallback", P.pair_position().alias("_at"),
                       F.when(F.col("_marked"), C.split_marked("_content", mode)).otherwise(one).alias("_found"))
    rows = rows.withColumn("_n_all", F.when(F.col("_marked"), F.size("_found")).otherwise(F.col("_n_pairs")).cast("long"))
    # explode_outer + filter keeps the optimizer from deriving the array twice
    pairs = (rows.select("_key", "_marked", "_unmatched", "_outside", "_fallback", "_at", "_n_all", F.posexplode_outer("_found").alias("_i", "_p"))
             .filter(F.col("_i").isNotNull()))
    pos = F.when(F.col("_marked"), F.col("_i").cast("long")).otherwise(F.col("_at"))
    last = pos == F.col("_n_all") - 1
    target = F.col("_p.traduction")
    said = F.when(last & F.col("_marked") & (target == F.lit("")) & (F.col("_outside") != F.lit("")), F.col("_outside")).otherwise(target)
    done = F.when(last & F.col("_unmatched") & (said == F.lit("")), F.col("_fallback")).otherwise(said)
    return pairs.select(*P.key_columns(keys), F.col("_marked").alias("marked"), F.col("_n_all").alias("n_pairs"), pos.alias("pos"),
                        F.col("_p.texte_cible").alias("texte_cible"), done.alias("traduction"))


def pair_counts_long(turns: DataFrame, keys: list[str], order: str = "turn", role: str = "role", content: str = "content",
                     mode: str = T.NATIVE, block: int = P.BLOCK) -> DataFrame:
    """(keys..., n_pairs, problem) per conversation, from the blocks
    alone (no pair is built)."""
    rows = P.turn_rows(turns, keys, order, role, content, block)
    heads = _blocks_with_facts(rows, None).filter("_head")
    n = F.when(F.col("_marked"), F.size(C.split_marked(F.col("_first._content"), mode))).otherwise(F.col("_n_pairs")).cast("long")
    return heads.select(*P.key_columns(keys), n.alias("n_pairs")).withColumn("problem", F.col("n_pairs") == 0)


def marked_openings(turns: DataFrame, keys: list[str], order: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """(keys..., content): the first message of the conversations it marks."""
    first = turns.groupBy(*keys).agg(F.min_by(F.struct(F.col(role).alias("role"), F.col(content).alias("content")), order).alias("_first"))
    return first.filter(C.is_marked_first(F.array("_first"))).select(*keys, F.col("_first.content").alias("content"))


def message_metrics(turns: DataFrame, keys: list[str], order: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """(keys..., n_messages, json_len, first_len) per conversation: E11, the
    length of E10's text and E13. All three are sums or extremes of numbers,
    collapsed before the shuffle."""
    message = F.array(F.struct(F.col(content).alias("content"), F.col(role).alias("role")))
    # the list's text is its messages' texts, commas between them and two brackets
    size = F.length(C.messages_json(message)) - 2
    facts = turns.select(*keys, F.col(order).alias("_order"), size.alias("_size"), C.first_message_length(message).alias("_len"))
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_messages"), (F.sum("_size") + F.count(F.lit(1)) + 1).cast("long").alias("json_len"),
                                    F.min_by("_len", "_order").alias("first_len"))


def json_message_counts(turns: DataFrame, keys: list[str], order: str = "turn", role: str = "role", content: str = "content",
                        block: int = P.BLOCK) -> DataFrame:
    """E11 over JSON text: (keys..., n_messages), each block's JSON array
    counted by itself."""
    message = F.struct(F.col(content).alias("content"), F.col(role).alias("role"))
    parts = turns.groupBy(*keys, F.floor(F.col(order) / block).alias("_blk")).agg(F.collect_list(message).alias("_m"))
    return parts.groupBy(*keys).agg(F.sum(C.message_count_json(C.messages_json("_m"))).alias("n_messages"))
