"""Scalar text functions (Column -> Column), all JVM-side built-ins.

``mode`` distinguishes the two input conventions:

* ``"native"``  -- real characters (an ARRAY<STRUCT> messages column);
* ``"row_repr"`` -- text that went through Python ``repr`` (literal ``\\n``,
  ``\\xa0``, ``\\'`` escapes), as in a stringified message list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paraspark import schemas as S

NATIVE = "native"
ROW_REPR = "row_repr"

# Java regex; (?d) makes '.' stop at the line feed only.
PREFIX_REGEX = f"(?d){S.PREFIX_WORD}.*?:{S.WS_CLASS}*"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(s: str) -> Column:
    return F.lit(s)


def strip_prefix(c) -> Column:
    """Remove every instruction prefix (word .*? ':' whitespace*)."""
    return F.regexp_replace(_c(c), PREFIX_REGEX, "")


def normalise_spaces(c) -> Column:
    """Literal four-character ``\\xa0``, U+00A0 and U+2009 become a space."""
    out = F.replace(_c(c), _lit("\\xa0"), _lit(" "))
    out = F.replace(out, _lit("\u00a0"), _lit(" "))
    return F.replace(out, _lit("\u2009"), _lit(" "))


def unescape_backslashes(c) -> Column:
    """D3: ``\\'`` -> ``'``, then every remaining backslash -> space (order matters)."""
    out = F.replace(_c(c), _lit("\\'"), _lit("'"))
    return F.replace(out, _lit("\\"), _lit(" "))


def strip_ws(c) -> Column:
    """Trim Unicode whitespace (str.isspace set) on both ends."""
    return F.btrim(_c(c), _lit(S.WS_CHARS))


def clean_text(c) -> Column:
    """D1 -> D2 -> D3 -> D4."""
    return strip_ws(unescape_backslashes(normalise_spaces(strip_prefix(c))))


def drop_newlines(c, mode: str = ROW_REPR) -> Column:
    """Delete newlines with no replacement (words fuse).

    ``row_repr`` deletes the two-character escape, ``native`` the real line feed.
    """
    return F.replace(_c(c), _lit("\\n" if mode == ROW_REPR else "\n"), _lit(""))


def drop_markers(c) -> Column:
    """Delete residual user/assistant markers."""
    out = F.replace(_c(c), _lit(S.ASSISTANT_MARK), _lit(""))
    return F.replace(out, _lit(S.USER_MARK), _lit(""))


def strip_full_prefix(c, prefix: str = S.FULL_PREFIX) -> Column:
    """Remove one fixed prefix then trim, only when the prefix occurs."""
    col = _c(c)
    return F.when(F.contains(col, _lit(prefix)),
                  strip_ws(F.replace(col, _lit(prefix), _lit("")))).otherwise(col)


def char_length(c) -> Column:
    """Length in code points."""
    return F.length(_c(c)).cast("long")


def classify_question(c, word_boundary: bool = False) -> Column:
    """D10: 'Question' if '?' occurs, or the lower-cased text starts with an
    interrogative (inside-word prefixes count unless ``word_boundary``), or
    contains one surrounded by single spaces; else 'Affirmation'."""
    low = F.lower(_c(c))
    starts = F.lit(False)
    inside = F.lit(False)
    for w in S.INTERROGATIVES:
        if word_boundary:
            starts = starts | low.rlike("^" + _regex_quote(w) + "(?![\\p{L}\\p{N}])")
        else:
            starts = starts | F.startswith(low, _lit(w))
        inside = inside | F.contains(low, _lit(f" {w} "))
    is_q = F.contains(_c(c), _lit("?")) | starts | inside
    return F.when(is_q, _lit(S.QUESTION)).otherwise(_lit(S.STATEMENT))


def _regex_quote(w: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in w)


def has_script(c, lo: int = S.ARABIC_RANGE[0], hi: int = S.ARABIC_RANGE[1]) -> Column:
    """True when any character falls in [lo, hi]."""
    return _c(c).rlike(f"[\\x{{{lo:x}}}-\\x{{{hi:x}}}]")


def split_lines(c) -> Column:
    """D12 (array form): trim, split on line feed, trim each, drop blanks."""
    parts = F.split(strip_ws(_c(c)), "\n")
    return F.filter(F.transform(parts, strip_ws), lambda s: s != _lit(""))


def mean_round(c, digits: int = 2) -> Column:
    """Mean rounded to ``digits`` decimals (aggregate expression)."""
    return F.round(F.avg(_c(c)), digits)


def ws_tokens(c) -> Column:
    """Maximal runs of non-whitespace (str.split() semantics) as an array."""
    t = strip_ws(c)
    return F.when(t == _lit(""), F.array().cast("array<string>")).otherwise(F.split(t, S.WS_CLASS + "+"))


def non_blank(c) -> Column:
    """Text that is not empty after trimming."""
    return strip_ws(_c(c)) != _lit("")
