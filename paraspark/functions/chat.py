"""Chat-message functions (Column -> Column) over ARRAY<STRUCT<content, role>>.

Everything runs per row: pairing is a pass over a string of roles (one letter
per message) and a filter by position, so extracting pairs needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from paraspark import schemas as S
from paraspark.functions import text as T

# Java regex of one stringified message: quote back-reference, dot-all.
ROW_REPR_REGEX = (
    "(?s)Row\\(content=(['\"])(.*?)\\1," + S.WS_CLASS + "*role=['\"](.*?)['\"]\\)"
)
USER_SPLIT = "<\\|user\\|>"
ASSISTANT_SPLIT = "<\\|assistant\\|>"
PAIR_ARRAY = ArrayType(S.PAIR)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pair(src: Column, tgt: Column) -> Column:
    return F.struct(src.alias("texte_cible"), tgt.alias("traduction"))


def empty_pairs() -> Column:
    return F.array().cast(PAIR_ARRAY)


def parse_row_repr(c) -> Column:
    """Parse ``[Row(content='..', role='..'), ...]`` text into messages."""
    s = _c(c)
    # the text is searched once; both groups are then taken from each match
    found = F.regexp_extract_all(s, F.lit(ROW_REPR_REGEX), 0)
    return F.transform(found, lambda x: F.struct(
        F.regexp_extract(x, ROW_REPR_REGEX, 2).alias("content"), F.regexp_extract(x, ROW_REPR_REGEX, 3).alias("role")))


def clean_side(c, mode: str) -> Column:
    """D6 -> D7 -> D5 on one side of a marked segment."""
    return T.clean_text(T.drop_markers(T.drop_newlines(c, mode)))


def split_marked(c, mode: str = T.NATIVE) -> Column:
    """Split a marked conversation string into pairs.

    Segments between user markers are trimmed and blanks dropped; in each,
    the text before the first assistant marker is the source and the text
    between the first and second marker the target (the rest is lost).
    """
    segs = F.filter(F.transform(F.split(_c(c), USER_SPLIT, -1), T.strip_ws),
                    lambda s: s != F.lit(""))

    def to_pair(seg):
        parts = F.split(seg, ASSISTANT_SPLIT, -1)
        src = T.strip_ws(F.get(parts, 0))
        tgt = F.coalesce(T.strip_ws(F.get(parts, 1)), F.lit(""))
        return _pair(clean_side(src, mode), clean_side(tgt, mode))

    return F.transform(segs, to_pair)


def greedy_pairs(messages) -> Column:
    """Greedy user -> assistant pairing over the message array.

    At a ``user`` message the next message is the target when it is an
    ``assistant`` message (else ''), and the scan advances by two either
    way; other roles advance by one. Content is used as given.
    """
    m = _c(messages)
    # one letter per message; each match is a user and the message it takes
    # with it, so the left-to-right matches are the visited users
    letters = F.array_join(F.transform(m, lambda x: F.when(x["role"] == F.lit("user"), "u").otherwise("o")), "")
    visited = F.split(F.regexp_replace(letters, "u(.?)", "V$1"), "")
    numbered = F.transform(m, lambda x, i: F.struct(x["content"].alias("content"), i.alias("i")))
    starts = F.filter(numbered, lambda x: F.get(visited, x["i"]) == F.lit("V"))
    return F.coalesce(F.transform(starts, lambda x: _pair(
        x["content"], F.when(F.get(m, x["i"] + 1)["role"] == F.lit("assistant"), F.get(m, x["i"] + 1)["content"])
        .otherwise(F.lit("")))), empty_pairs())


def clean_messages(messages, mode: str = T.NATIVE) -> Column:
    """D6 then D5 on every message content (roles unchanged)."""
    return F.transform(_c(messages), lambda x: F.struct(
        T.clean_text(T.drop_newlines(x["content"], mode)).alias("content"), x["role"].alias("role")))


def is_marked_first(messages) -> Column:
    """E4 condition: first message is ``user`` and holds a marker."""
    first = F.get(_c(messages), 0)
    content = first["content"]
    return F.coalesce((first["role"] == F.lit("user"))
                      & (F.contains(content, F.lit(S.ASSISTANT_MARK))
                         | F.contains(content, F.lit(S.USER_MARK))), F.lit(False))


def last_assistant(messages) -> Column:
    """Cleaned (D5 only) content of the last ``assistant`` message, '' if none."""
    asst = F.filter(_c(messages), lambda x: x["role"] == F.lit("assistant"))
    last = F.get(asst, F.size(asst) - 1)["content"]
    return F.coalesce(T.clean_text(T.strip_ws(last)), F.lit(""))


def fill_last_target(pairs, value, condition=None) -> Column:
    """Replace the last pair's target with ``value`` when it is empty
    (and ``condition`` holds); E5/E6 last-element rebuild."""
    p = _c(pairs)
    n = F.size(p)
    last_empty = F.coalesce(F.get(p, n - 1)["traduction"] == F.lit(""), F.lit(False))
    cond = last_empty if condition is None else (last_empty & condition)
    rebuilt = F.transform(p, lambda x, i: F.when(i == n - 1, _pair(x["texte_cible"], value))
                          .otherwise(x))
    return F.when(cond, rebuilt).otherwise(p)


def count_marker(c, marker: str) -> Column:
    """Non-overlapping occurrences of ``marker`` in a string."""
    s = F.coalesce(_c(c), F.lit(""))
    return ((F.length(s) - F.length(F.replace(s, F.lit(marker), F.lit("")))) / F.lit(len(marker))).cast("int")


def messages_marker_count(messages, marker: str) -> Column:
    """Marker occurrences summed over all message contents."""
    return F.aggregate(_c(messages), F.lit(0), lambda acc, x: acc + count_marker(x["content"], marker))


def add_pairs(df: DataFrame, messages: str = "messages", mode: str = T.NATIVE,
              fallback: str | None = None, text: str | None = None,
              out: str = "pairs") -> DataFrame:
    """E4 + E5 + E6 as staged projections (each array built once per row).

    E4: a marked first ``user`` message -> E2 on it, the last pair completed by
    the last assistant message outside it (E5); otherwise E3 on the messages
    cleaned by D6 then D5. E6: when user markers (+1) exceed assistant markers
    by exactly one and the last target is still empty, use the cleaned
    ``fallback`` column ('' when absent). ``text`` is the stringified list the
    markers are counted in (row_repr input); native input counts in contents.
    """
    m = F.col(messages)
    if text is not None:
        users = count_marker(F.col(text), S.USER_MARK) + 1
        assts = count_marker(F.col(text), S.ASSISTANT_MARK)
    else:
        users = messages_marker_count(m, S.USER_MARK) + 1
        assts = messages_marker_count(m, S.ASSISTANT_MARK)
    fb = T.clean_text(F.coalesce(F.col(fallback), F.lit(""))) if fallback else F.lit("")
    keep = [c for c in df.columns]
    stage1 = df.select(
        *keep,
        is_marked_first(m).alias("_mk"),
        split_marked(F.get(m, 0)["content"], mode).alias("_sp"),
        last_assistant(m).alias("_ext"),
        clean_messages(m, mode).alias("_cm"),
        ((users - assts) == F.lit(1)).alias("_unmatched"),
        fb.alias("_fb"),
    )
    stage2 = stage1.select(
        *keep, "_unmatched", "_fb",
        F.when(F.col("_mk"), fill_last_target("_sp", F.col("_ext"), F.col("_ext") != F.lit("")))
        .otherwise(greedy_pairs("_cm")).alias("_p0"))
    return stage2.select(
        *keep, fill_last_target("_p0", F.col("_fb"), F.col("_unmatched")).alias(out))


def has_no_pairs(pairs) -> Column:
    """Quarantine flag."""
    return F.coalesce(F.size(_c(pairs)), F.lit(0)) == F.lit(0)


def pair_count(pairs) -> Column:
    """E9."""
    return F.coalesce(F.size(_c(pairs)), F.lit(0)).cast("long")


def message_count(messages) -> Column:
    """E11 (native array): 0 on null."""
    return F.coalesce(F.size(_c(messages)), F.lit(0)).cast("long")


def message_count_json(c) -> Column:
    """E11 (JSON text): 0 on null or unparseable."""
    return F.coalesce(F.json_array_length(_c(c)), F.lit(0)).cast("long")


def first_message_length(messages) -> Column:
    """Length of the first message content after D8; 0 when absent."""
    first = F.get(_c(messages), 0)["content"]
    return F.coalesce(F.length(T.strip_full_prefix(first)), F.lit(0)).cast("long")


def messages_json(messages) -> Column:
    """E10."""
    return F.to_json(_c(messages))
