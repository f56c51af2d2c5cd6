import html
import itertools
import random
import re

from paraspark.llm import html_mincut as H
from tests.llm.helpers import parquet_rows

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div id="cookie-notice"><p>This site uses cookies, as a long notice will tell you here.</p></div>
<main><h1>Title &eacute; &#233; &amp;c</h1><p>First  <a href="x">linked</a>
text.<br>More.<p>Second <b>para</b></p><ul><li>one item</li><li>two items</li></ul><script>var a = "<p>no</p>";</script>
<aside><p>Side text that is long enough to look like an article.</p></aside><form><label>Mail</label><textarea>x</textarea></form>
<section class="comments"><p>Great article, I liked it a lot, and so did all of my friends!</p></section></main>
<div class="ad">Buy this now.</div><footer><p>Imprint</p></footer></body></html>"""


def test_parts_of_a_page():
    assert H.main_text(PAGE) == "Title é é &c\n\nFirst linked text. More.\n\nSecond para\n\none item\n\ntwo items"


def test_odd_pages():
    assert [H.main_text(x) for x in (None, "", " ", "<", "<nav>x</nav>", "<!-- never closed", "<script>never closed")] == [""] * 7
    assert H.main_text("<article><p>a &amp b &quo &#x41; &unknown; 1 < 2</article>") == "a & b &quo A &unknown; 1 < 2"
    assert H.main_text("</div></p><article><p>stray</b></i></article></section>") == "stray"
    long = "word " * 200_000
    assert H.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert H.main_text("<article>" + "<div>" * 3000 + "<p>deep</p></article>") == "deep"


def test_layout_words():
    text = "This is the article itself, long enough to be told from the rest of the page."
    assert H.main_text(f'<body class="has-sidebar ad-free"><div class="entry-content comments-closed"><p>{text}</p></div>'
                       f'<div class="ad-content"><p>{text}</p></div><div id="sidebar"><p>{text}</p></div></body>') == text


def brute(toward, edges):
    """Least cost over all labellings, and the largest source side of those
    is not needed: the cost alone decides."""
    best = None
    for side in itertools.product([False, True], repeat=len(toward)):
        cost = sum(int(-t * 1000) if s and t < 0 else int(t * 1000) if not s and t > 0 else 0 for s, t in zip(side, toward))
        cost += sum(int(w * 1000) for a, b, w in edges if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


def test_min_cut_against_all_labellings():
    r = random.Random(6)
    for _ in range(150):
        n = r.randrange(1, 9)
        toward = [round(r.uniform(-2, 2), 3) for _ in range(n)]
        edges = [(i, j, round(r.uniform(0, 1.5), 3)) for i in range(n) for j in range(i) if r.random() < 0.5]
        side = H.min_cut(toward, edges)
        cost = sum(int(-t * 1000) if s and t < 0 else int(t * 1000) if not s and t > 0 else 0 for s, t in zip(side, toward))
        cost += sum(int(w * 1000) for a, b, w in edges if side[a] != side[b])
        assert cost == brute(toward, edges)


def test_smoothness_carries_a_doubtful_block():
    assert H.min_cut([2.0, -0.2, 2.0], [(0, 1, 0.4), (1, 2, 0.4)]) == [True, True, True]
    assert H.min_cut([-2.0, 0.2, -2.0], [(0, 1, 0.4), (1, 2, 0.4)]) == [False, False, False]


def test_given_pages(spark, sf_small):
    rows = {r.page_id: r for r in parquet_rows(spark, sf_small, "pages").collect()}
    got = H.extract(parquet_rows(spark, sf_small, "pages")).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", rows[r.page_id].html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_null_columns_repeats_and_empty_table(spark):
    d = spark.createDataFrame([(None, None, None, "x"), (1, "u", PAGE, "x"), (1, "u", PAGE, "x")], "page_id LONG, url STRING, html STRING, text STRING")
    got = sorted((str(r.page_id), r.n_chars) for r in H.extract(d).collect())
    assert got == [("1", len(H.main_text(PAGE)))] * 2 + [("None", 0)]
    assert H.extract(d.limit(0)).count() == 0


def test_hidden_elements_end():
    """Self-closed, closed and never-closed elements that are not raw text."""
    for mark in ('<svg class="i"/>', '<svg><title>t</title><g>x</g></svg>', "<button><div>Menu</div></button>",
                 "<select><option>a<option>b</select>", "<canvas>c</canvas>", "<template><p>t</p></template>", "<object>o<svg>s</svg></object>"):
        page = f"<article><p>Three {mark} four</p><p>Five</p></article>"
        assert H.main_text(page) == "Three four\n\nFive", mark
    for mark in ("<svg>", "<button>", "<select><option>", "<canvas>", "<object>", "<template>"):
        assert H.main_text(f"<article><p>One</p><p>Three {mark} four</p><p>Five</p></article>").split("\n\n")[::2] == ["One", "Five"], mark
        assert H.main_text(f"<article><p>One</p>{mark}<p>Five</p><div>Six</div></article>") == "One\n\nFive\n\nSix", mark
    assert H.main_text("<article><p>a <button>x <button>y</button> b</p></article>") == "a b"
    assert H.main_text("<article><p>a <script>x</p><p>b</script> c</p></article>") == "a c"


def sentence(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("red stone walks over green hill while seven birds sing".split()) for _ in range(n // 5))[:n].strip()


def test_article_in_an_unnamed_container():
    """Lists, tables and plain blocks between and after the paragraphs stay;
    what is linked or named away does not."""
    p1, p2 = sentence(300, 1), sentence(300, 2)
    items, cells = [sentence(100, i) for i in range(3, 8)], [sentence(30, i) for i in range(8, 12)]
    plain, note = sentence(120, 12), sentence(60, 13)
    ul = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    table = "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in cells) + "</table>"
    body = f"<h2>Heading</h2><p>{p1}</p>{ul}<p>{p2}</p>{table}<section>{plain}</section><figure><figcaption>{note}</figcaption></figure>"
    links = "<ul>" + "".join(f'<li><a href="/{i}">Another page {i}</a></li>' for i in range(6)) + "</ul>"
    want = "\n\n".join(["Heading", p1, *items, p2, *cells, plain, note])
    for away in ("", f"<nav>{links}</nav>", f'<div class="c3">{links}</div>', f'<div class="sidebar"><p>{p1}</p></div>'):
        assert H.main_text(f"<html><body>{away}<div class='c7'>{body}</div>{away}<div class='c9'>Imprint</div></body></html>") == want
    assert H.main_text(f"<html><body>{links}<p>{p1}</p>{ul}<p>{p2}</p>{links}<div>Imprint</div></body></html>") == "\n\n".join([p1, *items, p2])


def test_a_named_article_keeps_unnamed_blocks_out():
    p1, p2 = sentence(300, 1), sentence(300, 2)
    assert H.main_text(f"<article><p>{p1}</p><p>{p2}</p></article><div class='c1'><div>{sentence(120, 3)}</div></div>") == f"{p1}\n\n{p2}"


def test_attribute_values_are_not_attributes():
    """Only the standard's own attributes speak, by their full names; quotes
    inside unquoted values are text."""
    for mark in ('<p title="a hidden gem">', '<section aria-label="the hidden valley">', '<p data-role="dialog">', '<p data-id="share-3">',
                 "<p data-class=sidebar>", '<p title="role=menu">', "<p x-hidden>", '<p alt="display:none">'):
        assert H.main_text(f"<article><p>One</p>{mark}Two</p><p>Three</p></article>").split("\n\n") == ["One", "Two", "Three"], mark
    assert H.main_text("<article><p>FIRST</p><p title=don't>SECOND</p><p>THIRD it's</p></article>") == "FIRST\n\nSECOND\n\nTHIRD it's"
    for mark in ("<p hidden>", "<p HIDDEN=''>", '<p style="color:red; display: none">', "<div role=dialog>", "<p aria-hidden=true>", "<div class=sidebar>",
                 "<div id='share-3'>", '<div title="it\'s > that" class="sidebar">'):
        assert H.main_text(f"<article><p>One</p>{mark}Two</p></div><p>Three</p></article>").split("\n\n")[0::2] == ["One"] or \
            "Two" not in H.main_text(f"<article><p>One</p>{mark}Two</p></div><p>Three</p></article>"), mark


def test_broken_pages_take_linear_time():
    import time
    n = 100_000
    pages = ["<article>" + "<b>x " * n, "<div>" * n + "x", "<div><p>some text</p>" * (n // 2), "<a " * n, "<svg>" * n, "<b>" * n + "</i></p>" * n,
             "<a b=\"<c d='" * n, "<li>x" * n, "<button>x" * n]
    for page in pages:
        start = time.perf_counter()
        H.main_text(page)
        assert time.perf_counter() - start < 4, page[:30]


def test_the_cut_changes_labels():
    """A doubtful line between paragraphs of an article follows them, and a
    doubtful line among boilerplate stays there, against the classifier's sign."""
    p1, p2, line = sentence(300, 1), sentence(300, 2), "Short <a href='/x'>linked note</a>"
    page = f"<article class='c1'><p>{p1}</p><div class='widget content'>x</div><div><a href='/y'>{sentence(40, 5)}</a> a</div><p>{p2}</p></article>"
    changed = 0
    for page in (page, f"<body><p>{p1}</p><div>{line}</div><p>{p2}</p></body>",
                 f"<body><div class='sidebar'>{p1}</div><p>Go on</p><div class='sidebar'>{p2}</div><div class='nav'>{p1}</div></body>"):
        bs, parents, depths = H.blocks(page)
        z = H.scores(bs, parents, depths)
        keep = H.min_cut(z, H.smoothness(bs, parents, depths))
        changed += sum(k != (s > 0) for k, s in zip(keep, z))
    assert changed
