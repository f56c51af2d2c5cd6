"""Candidate-text extraction from HTML (Column -> Column), regex based.

A paragraph is the text from a ``<p>`` start tag up to its ``</p>`` or the
next start of a paragraph or block (an unclosed ``<p>`` ends there, as in a
browser); script, style and comment bodies are removed first so that markup
inside them cannot be mistaken for a paragraph.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from paraspark import schemas as S
from paraspark.functions import text as T

NON_CONTENT = ["(?is)<script\\b[^>]*>.*?</script>", "(?is)<style\\b[^>]*>.*?</style>", "(?s)<!--.*?-->"]
P_START = "(?i)<p(?:\\s[^>]*)?>"
P_END = "(?is)(?:</p>|</article>|</div>|</body>|</section>|<h[1-6][\\s>]|<ul[\\s>]|<table[\\s>]).*"
TAG = "<[^>]*>"
# a complete character reference right after its '&'
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# the standard's named references, from the Python library's own table
NAMED = {name: chr(cp) for name, cp in sorted(name2codepoint.items())} | {"apos": "'"}

# Script range used for the driver pages (accented Latin); the reference uses Arabic.
LATIN_ACCENTS = (0x00C0, 0x00FF)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_non_content(html) -> Column:
    out = _c(html)
    for pat in NON_CONTENT:
        out = F.regexp_replace(out, pat, "")
    return out


def decode_references(text) -> Column:
    """Named, decimal and hexadecimal character references decoded in one pass
    (``&amp;lt;`` gives ``&lt;``); unknown or incomplete ones stay as they are."""
    parts = F.split(_c(text), "&", -1)
    names = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])

    def char(code: Column) -> Column:
        ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    def decoded(p):
        ref = F.regexp_extract(p, REFERENCE, 1)
        got = (F.when(ref == "", F.lit(None).cast("string"))
               .when(F.lower(F.substring(ref, 1, 2)) == "#x", char(F.conv(F.substring(ref, 3, 8), 16, 10).cast("long")))
               .when(F.substring(ref, 1, 1) == "#", char(F.substring(ref, 2, 8).try_cast("long")))
               .otherwise(F.try_element_at(names, ref)))
        return F.when(got.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(got, F.substring(p, F.length(ref) + 2, F.length(p))))

    return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))


def decoded_text(text) -> Column:
    """``decode_references`` where there can be one: most texts hold no '&'."""
    return F.when(F.contains(_c(text), F.lit("&")), decode_references(text)).otherwise(_c(text))


def text_content(fragment) -> Column:
    """Tags removed, references decoded (textContent of a fragment)."""
    return decoded_text(F.regexp_replace(_c(fragment), TAG, ""))


def paragraphs(html, lo: int = S.ARABIC_RANGE[0], hi: int = S.ARABIC_RANGE[1]) -> Column:
    """ARRAY<STRUCT<pos, text, has_script>> in document order."""
    segs = F.split(strip_non_content(html), P_START, -1)
    body = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
    # the inner list is built once; its elements are then read as often as needed
    texts = F.transform(body, lambda s: F.regexp_replace(F.regexp_replace(s, P_END, ""), TAG, ""))
    return F.transform(texts, lambda t, i: F.struct(i.alias("pos"), decoded_text(t).alias("text")))


def with_script_flag(paras, lo: int, hi: int) -> Column:
    return F.transform(_c(paras), lambda p: F.struct(p["pos"].alias("pos"), p["text"].alias("text"),
                                                   T.has_script(p["text"], lo, hi).alias("has_script")))


def first_valid(paras, sentinel: str = S.SENTINEL_LABEL) -> Column:
    """First paragraph with the script that is not the sentinel label."""
    ok = F.filter(_c(paras), lambda p: p["has_script"] & (p["text"] != F.lit(sentinel)))
    return F.get(ok, 0)["text"]


def valid_candidate(c, lo: int, hi: int, sentinel: str = S.SENTINEL_LABEL,
                    error_prefix: str = S.ERROR_PREFIX) -> Column:
    x = _c(c)
    return F.coalesce((F.length(x) > 0) & ~F.startswith(x, F.lit(error_prefix))
                      & (x != F.lit(sentinel)) & T.has_script(x, lo, hi), F.lit(False))


def first_valid_of(candidates: list, lo: int, hi: int) -> Column:
    """Ordered fallback: the first candidate that passes ``valid_candidate``."""
    return F.coalesce(*[F.when(valid_candidate(c, lo, hi), c) for c in candidates])


def title(html) -> Column:
    return text_content(F.regexp_extract(_c(html), "(?is)<title[^>]*>(.*?)</title>", 1))
