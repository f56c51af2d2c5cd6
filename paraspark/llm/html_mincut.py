"""Main text of a web page by minimum-cut labelling.

A page becomes a row of text blocks. A fixed linear classifier over a block's
ancestors, class and id words, link share and length gives the cost of calling
it content or boilerplate; these costs are the capacities to the two
terminals. Neighbouring blocks and consecutive children of one parent are
joined by smoothness edges, the stronger the closer they are in the DOM. On a
page that does not name its article the elements that hold article-like
paragraphs lend to their other blocks. The
minimum cut (max-flow by shortest augmenting layers) separates content from
boilerplate: an isolated doubtful block follows its surroundings.

Every page is labelled on its own inside the scan's tasks; memory is one page.

Defined results: NULL or empty html gives ''; a page with no content block
gives ''; unclosed and stray tags are tolerated; references that are not
complete stay as they are; repeated rows give the same text each; an empty
table gives an empty result; other columns are ignored. Nothing is cut off:
all text of a content block is kept, however long.
"""

from __future__ import annotations

import html as _html
import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import map_arrow, table
from paraspark.plans.registry import register

# FIXED VALUES: element names of the HTML standard by how they are shown.
# Parameters: the words sites use in class and id attributes for what is not the article.
RAW = "script style noscript iframe textarea title".split()
#: Ordinary elements whose text is not the page's.
HIDDEN = set("svg select button object canvas template".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
            "th thead tr ul head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their class and id words describe the page's layout, not their content.
WHOLE = {"html", "body", "main", "article"}
AWAY = set("nav footer aside form menu dialog fieldset".split())
AWAY_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
AWAY_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar "
                 "navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice "
                 "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment "
                 "comments commentlist respond reply disqus related recommended recommendations widget pagination pager copyright "
                 "legal disclaimer tags search skip".split())
#: Elements that say nothing for or against their text.
PLAIN = set("li td th dd dt div section figcaption caption".split())
HOME_WORDS = set("article content entry post story main body text".split())

# an attribute: a name, and a value in quotes or up to the next white space
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
                    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*+)(?P<attrs>(?:[\s/]++|[^\s/>=<]++(?:" + _VALUE + r")?+|=)*+)>", re.S | re.I)
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPEAKING = {"class", "id", "role", "style", "aria-hidden", "hidden"}
_NAME_WORDS = re.compile(r"[a-z]+")
_SAME = {t: re.compile(rf"<(/?){t}\b", re.I) for t in HIDDEN}


#: Score from which a block is evidence for what holds it, and the most that lends.
STRONG, LENT = 1.0, 2.0


class Block:
    """``node``: the block element that holds the text (-1: none), ``top``:
    how many of its ancestors are html or body."""
    __slots__ = ("text", "tag", "node", "away", "home", "links", "top")

    def __init__(self, text, tag, node, away, home, links, top):
        self.text, self.tag, self.node, self.away, self.home, self.links, self.top = text, tag, node, away, home, links, top


class _Open(NamedTuple):
    """An open element and what it and its ancestors say together."""
    tag: str
    node: int            # of the nearest block element
    away: int
    home: int
    linked: bool
    article: bool
    top: int


_ROOT = _Open("body", -1, 0, 0, False, False, 0)


def _judge(tag: str, attrs: str, in_article: bool) -> tuple[int, int]:
    """How strongly an element speaks against and for its content."""
    away, home = int(tag in AWAY), 0
    if tag == "header" and not in_article:
        away = 1
    if tag in ("article", "main"):
        home = 2
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), "".join(values).lower()
        if name not in _SPEAKING:
            continue
        if name in ("class", "id") and tag not in WHOLE:
            # name by name: "entry-content comments-closed" is the article, "ad-content" is not
            names = [set(_NAME_WORDS.findall(v)) for v in value.split()]
            good = any(n & HOME_WORDS and not n & AWAY_WORDS for n in names)
            home += good
            away += not good and any(n & AWAY_WORDS for n in names)
        elif name == "role":
            away += value in AWAY_ROLES
            home += 2 * (value in ("main", "article"))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            away += 2
    return away, home


def blocks(page: str) -> tuple[list[Block], list[int], list[int]]:
    """Text blocks in page order with what their ancestors say, and the parent
    and depth of every block element. One step per token, however deep."""
    out: list[Block] = []
    stack: list[_Open] = []
    where: dict[str, list[int]] = {}   # places on the stack by tag
    block_at: list[int] = []           # places of the open block elements
    hidden: list[int] = []             # places of the open hidden elements
    endless: list[int] = []            # those of them that are never closed
    parents: list[int] = []
    depths: list[int] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = stack[block_at[-1]].tag if block_at else "body"
                o = stack[-1] if stack else _ROOT
                out.append(Block(text, own, o.node, o.away, o.home, min(1.0, linked / len(text)), o.top))
            parts, linked = [], 0

    def cut(place):
        while len(stack) > place:
            where[stack.pop().tag].pop()
        for places in (block_at, hidden, endless):
            while places and places[-1] >= place:
                places.pop()

    def say(text):
        nonlocal linked
        if hidden:
            return
        text = _html.unescape(text)
        parts.append(text)
        if stack and stack[-1].linked:
            linked += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if not tag:
            if m.group("raw") and m.group("raw").lower() != "title":
                parts.append(" ")
            continue
        tag = tag.lower()
        if m.group("end"):
            place = where[tag][-1] if where.get(tag) else -1
            if hidden and 0 <= place < hidden[0]:
                cut(hidden[0])           # the parent's end is theirs
            if tag in BLOCK and not hidden:
                flush()
            if place >= 0:
                cut(place)
            continue
        # a hidden element that is never closed ends where a block begins
        ends = tag in BLOCK or (tag in ("button", "select") and where.get(tag))
        if ends and endless:
            cut(endless[0])
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            if not hidden:
                flush()
            # a block ends an open paragraph, with the inline elements in it
            if block_at and (not hidden or block_at[-1] > hidden[-1]):
                inner = stack[block_at[-1]].tag
                if inner == "p" or (tag == "li" and inner == "li"):
                    cut(block_at[-1])
        if tag in HIDDEN:
            parts.append(" ")
        if tag not in VOID and not m.group("attrs").endswith("/"):
            o = stack[-1] if stack else _ROOT
            place = len(stack)
            where.setdefault(tag, []).append(place)
            if tag in HIDDEN:
                same = _SAME[tag].search(page, at)
                hidden.append(place)
                if not (same and same.group(1)):
                    endless.append(place)
                stack.append(o._replace(tag=tag))
                continue
            away, home = _judge(tag, m.group("attrs"), o.article)
            node = o.node
            if tag in BLOCK:
                parents.append(node)
                depths.append(depths[node] + 1 if node >= 0 else 1)
                node = len(parents) - 1
                block_at.append(place)
            stack.append(_Open(tag, node, o.away + away, max(o.home, home), o.linked or tag == "a",
                               o.article or tag in ("article", "main"), o.top + (tag in ("html", "body"))))
    if at < len(page):
        say(page[at:])
    flush()
    return out, parents, depths


def content_score(b: Block, named: bool = True) -> float:
    """Classifier: log-odds that the block belongs to the article. Where the
    page does not name its article, a list item, a cell or a plain container
    is no evidence against it."""
    z = -1.0 - 7.0 * b.away + 2.5 * b.home
    if not named and b.tag in PLAIN:
        return z + 0.5 - 3.0 * b.links + min(1.5, 0.5 * math.log1p(len(b.text) / 40))
    z += {"p": 1.5, "pre": 1.0, "blockquote": 1.0, "li": -0.5, "td": -0.5, "body": 0.7}.get(b.tag, 0.5 if b.tag[0] == "h" and b.tag[1:].isdigit() else 0.0)
    return z - 3.0 * b.links + min(1.5, 0.5 * math.log1p(len(b.text) / 40))


def scores(bs: list[Block], parents: list[int], depths: list[int]) -> list[float]:
    """Log-odds of all blocks of a page.

    Where most of the text that reads like an article lies outside the
    elements named as one, the page's own evidence counts: an element that
    holds such paragraphs lends to its other blocks, and the element around it
    (or the body) to those between its first and last such paragraph.
    """
    z = [content_score(b, False) for b in bs]
    strong = [i for i, b in enumerate(bs) if z[i] >= STRONG and not b.home and not b.away and b.links < 0.3]
    named = sum(len(b.text) for b in bs if b.home and not b.away)
    if named and named >= sum(len(bs[i].text) for i in strong):
        return [content_score(b) for b in bs]
    inside: dict[int, float] = {}
    around: dict[int, list] = {}     # evidence, first and last strong block
    for i in strong:
        node = parents[bs[i].node] if bs[i].node >= 0 else -1
        for step in range(2):
            if node < 0:
                break
            if step == 0 and depths[node] > bs[i].top:
                inside[node] = inside.get(node, 0.0) + z[i]
            else:
                span = around.setdefault(node, [0.0, i, i])
                span[0], span[2] = span[0] + z[i], i
            node = parents[node]
    # per element: the most that it or an ancestor holds, and the nearest that a span lies around
    most, near = [0.0] * len(parents), [-1] * len(parents)
    for node, parent in enumerate(parents):  # parents come first
        most[node] = max(inside.get(node, 0.0), most[parent] if parent >= 0 else 0.0)
        near[node] = node if node in around else near[parent] if parent >= 0 else -1
    for i, b in enumerate(bs):
        if not b.away and not b.home and b.node >= 0:
            lent = most[b.node]
            node = near[b.node]
            while node >= 0 and lent < LENT / 0.7:
                e, first, last = around[node]
                if first <= i <= last:
                    lent = max(lent, e)
                node = near[parents[node]] if parents[node] >= 0 else -1
            z[i] += min(LENT, 0.7 * lent)
    return z


def smoothness(bs: list[Block], parents: list[int], depths: list[int]) -> list[tuple[int, int, float]]:
    """Edges between neighbours and between consecutive children of a parent."""
    def up(node):
        return parents[node] if node >= 0 else -1

    def depth(node):
        return depths[node] if node >= 0 else 0

    edges, last = [], {}
    for i, b in enumerate(bs):
        if i:
            x, y, apart = bs[i - 1].node, b.node, 0
            while x != y:  # to the nearest common ancestor
                if depth(x) >= depth(y):
                    x = up(x)
                else:
                    y = up(y)
                apart += 1
            edges.append((i - 1, i, 1.2 / (1 + apart)))
        parent = up(b.node)
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, 0.4))
        last[parent] = i
    return edges


def min_cut(toward: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of the minimum cut. ``toward[i]`` is the source
    capacity of node i less its sink capacity; edges hold in both directions."""
    n = len(toward)
    cap: list[int] = []
    to: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, w in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        cap += [int(w * 1000)] * 2
    left = [int(t * 1000) for t in toward]      # > 0: flow still to send, < 0: room at the sink
    while True:
        # layers from all nodes with flow to send, then augmenting walks along them
        depth = [0 if left[i] > 0 else -1 for i in range(n)]
        queue = [i for i in range(n) if left[i] > 0]
        ends = False
        for i in queue:
            if left[i] < 0:
                ends = True
                continue
            for e in out[i]:
                if cap[e] and depth[to[e]] < 0:
                    depth[to[e]] = depth[i] + 1
                    queue.append(to[e])
        if not ends:
            return [d >= 0 for d in depth]
        turn = [0] * n
        for s in range(n):
            while left[s] > 0:
                walk, i = [], s
                while left[i] >= 0:
                    while turn[i] < len(out[i]) and not (cap[out[i][turn[i]]] and depth[to[out[i][turn[i]]]] == depth[i] + 1):
                        turn[i] += 1
                    if turn[i] < len(out[i]):
                        walk.append(out[i][turn[i]])
                        i = to[walk[-1]]
                    elif walk:
                        i = to[walk.pop() ^ 1]
                        turn[i] += 1
                    else:
                        break
                if left[i] >= 0:
                    break
                flow = min(left[s], -left[i], *(cap[e] for e in walk))
                for e in walk:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                left[s] -= flow
                left[i] += flow


def main_text(page: str | None) -> str:
    bs, parents, depths = blocks(page or "")
    if not bs:
        return ""
    # log-odds: the cheaper terminal capacity is sent straight through
    keep = min_cut(scores(bs, parents, depths), smoothness(bs, parents, depths))
    return "\n\n".join(b.text for b, k in zip(bs, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    def run(batches):
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    return map_arrow(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")), run,
                     "page_id LONG, url STRING, text STRING, n_chars LONG")


@register("op7_mincut_html")
def op7_mincut_html(spark, d):
    """Main text of every page."""
    return extract(table(spark, d, "pages"))
