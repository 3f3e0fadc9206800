import html
import random
import re
import time

import pytest

from foretell.llm import wrappers as w
from foretell.llm import queries


def brute_article(page):
    """The texts between <article> and </article>, block by block."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)
    parts = re.split(r"</?(?:p|h1)>", body[1] if body else "")
    plain = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?[a-z][^>]*>", "", p))).strip() for p in parts)
    return "\n".join(p for p in plain if p)


def test_whole_table_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op10_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == brute_article(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text)
        assert got[p.page_id].url == p.url


FRAME = '<html><head><title>T &amp; t</title><style>p{}</style></head><body class="page"><header><p>Site head</p></header><nav><ul><li>Home<li>News</ul></nav><div id="cookie-notice"><p>We use cookies</p></div>%s<aside class="sidebar"><p>Side</p></aside><section class="comments"><article class="comment"><p>First!</p></article></section><form><p>Sign up</p></form><script>document.write("<article><p>no</p></article>")</script><footer><p>&copy; me</p></footer></body></html>'


def test_variants_of_one_host(spark):
    bodies = {
        "plain": ("<article><h1>Head&shy;line</h1><p>One &lt;b&gt; two</p></article>", "Head\xadline\nOne <b> two"),
        "broken": ("<article><h1>H</h1><p><b>Bold<br><p>next\n  line</article>", "H\nBold\nnext line"),
        "inside": ('<article><p>a<span>b</span> <a href="x>y">c</a></p><div class="ad">Buy</div><nav>more</nav><!-- <p>x</p> --><ul><li>i<li>j</ul><aside>z</aside><p hidden>secret</p></article>', "ab c\ni\nj"),
        "cut": ("<article><p>cut <i>off", "cut off"),
        "empty": ("", ""),
        "nested": ("<article><section><h2>S</h2><p>T</p></section><table><tr><td>1<td>2</table></article>", "S\nT\n1\n2"),
    }
    rows, want = [], {}
    for n, (name, (body, text)) in enumerate(bodies.items()):
        page = FRAME % body
        rows.append((n, "https://Host.example:80/x", page.split("off")[0] + "off" if name == "cut" else page, name))
        want[n] = text
    rows += [(50, None, None, ""), (51, "http://host.example/", "", ""), (52, "not a url", "<p>lone", ""), (None, "https://host.example/y", FRAME % "<article><p>q</p></article>", ""), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = w.extract(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts == want | {50: "", 51: "", 52: "lone", None: "q"}
    assert w.extract(pages.limit(0)).collect() == []


def test_pages_without_an_article_element(spark):
    page = '<body><div class="menu"><p>m</p></div><div class="wrap"><div class="body-text">' + "".join(f"<p>Paragraph {i} has some words in it.</p>" for i in range(9)) + "</div><div>tail</div></div></body>"
    pages = spark.createDataFrame([(1, "http://a.example/1", page), (2, "http://a.example/2", page.replace("Paragraph", "Section"))], "page_id long, url string, html string")
    for r in w.extract(pages).collect():
        assert r.text.count("\n") == 8 and "tail" not in r.text and "m\n" not in r.text


def expand(item, rng):
    """A stream that a wrapper describes."""
    if not item.startswith("( "):
        return [item]
    times = {"+": rng.choice([1, 2, 3]), "?": rng.choice([0, 1])}[item[-1]]
    return [x for _ in range(times) for b in w._body(item) for x in expand(b, rng)]


def pattern(items):
    out = ""
    for item in items:
        out += "(?:" + (pattern(w._body(item)) + ")" + item[-1] if item.startswith("( ") else re.escape(item) + " )")
    return out


def test_a_wrapper_describes_every_page_it_was_made_from():
    rng = random.Random(4)
    template = "<body> ( <ul> ( <li> #li </li> )+ </ul> )? <article> <h1> #h1 </h1> ( <p> #p </p> ( <hr> )? )+ </article> ( <footer> #f </footer> )? </body>"
    pages = []
    for _ in range(40):
        items = []
        for x in [y for b in w._body(f"( {template} )") for y in expand(b, rng)]:
            items.append(x)
            w._squash(items)
        pages.append(items)
    wrapper = pages[0]
    for p in pages[1:]:
        wrapper = w.align(wrapper, p)
    slots = set(re.findall(r"#\w+", " ".join(wrapper)))
    assert slots == {"#li", "#h1", "#p", "#f"}
    assert len(w._body(f"( {' '.join(wrapper)} )")) == len(wrapper)


@pytest.mark.parametrize("text", ["<" * 20000, "<a b='" * 5000, "<p" * 20000, "<div>" * 3000, "<script>" + "x" * 100000, "a<b<c>d", "&#x110000;&bogus;&am"])
def test_hostile_pages_end(text):
    items, mass = w.shape(text)
    assert w.main_text(text, set(mass)) is not None


def test_two_templates_on_one_host(spark):
    news = "<body><nav><p>n</p></nav><article><p>News %d</p></article></body>"
    blog = '<body><div class="side"><p>s</p></div><div class="post"><p>Blog %d is a longer text</p></div></body>'
    bare = '<body><div class="left"><p>l</p></div><div class="text"><p>Bare page %d has only this much longer paragraph</p></div></body>'
    rows = [(0, "http://h.example/0", news % 0)] + [(i, f"http://h.example/{i}", (blog if i < 8 else bare) % i) for i in range(1, 12)]
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {0: "News 0"} | {i: f"Blog {i} is a longer text" if i < 8 else f"Bare page {i} has only this much longer paragraph" for i in range(1, 12)}
    assert got == want


def test_templates_sent_and_joined_agree(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://h.example/1", FRAME % "<article><p>a</p></article>"), (2, None, FRAME % '<div class="post"><p>b</p></div>'), (3, None, None)], "page_id long, url string, html string")
    monkeypatch.setattr(w, "BROADCAST_BYTES", -1)
    assert {r.page_id: r.text for r in w.extract(pages).collect()} == {1: "a", 2: "b", 3: ""}


def test_the_wrapper_tells_template_text_from_the_article(spark):
    page = '<body><article><p class="by">Read in %s minutes</p><h1>Head %d</h1>%s<p>Share</p><hr><p>Written for you</p></article></body>'
    rows = [(i, f"http://h.example/{i}", page % ("two", i, "<p>Share</p>" * (i == 3) + "".join(f"<p>Text {i} {k} of some length</p>" for k in range(i % 3 + 1)))) for i in range(12)]
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        lines = got[i].split("\n")
        assert lines[0] == f"Head {i}" and "Written for you" not in lines and "Read in two minutes" not in lines
        assert [x for x in lines if x.startswith("Text")] == [f"Text {i} {k} of some length" for k in range(i % 3 + 1)]


def test_another_wrapper_gives_another_text():
    page = "<body><article><p>Share</p><hr><p>Own</p><p>Share</p></article></body>"
    keep, slot = {"body>article>p"}, "#body>article>p"
    one = w.Wrapper(f"<body> <article> <p> {slot} </p> <hr> ( <p> {slot} </p> )+ </article> </body>")
    two = w.Wrapper(f"<body> <article> ( <p> {slot} </p> ( <hr> )? )+ </article> </body>")
    assert [at for at, _ in w.blocks(w.stream(page), keep, one)] == [3, 7, 7]
    assert w.main_text(page, keep, one, {3: {w.digest("Share")}}) == "Own\nShare"
    assert w.main_text(page, keep, two, {3: {w.digest("Share")}}) == "Own"
    assert w.main_text(page, keep) == "Share\nOwn\nShare"


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", FRAME % "<article><p>The same</p></article>") for i in range(9)]
    assert {r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"The same"}


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body><div class="layout has-sidebar"><article><p>a</p></article></div></body>', "a"),
        ('<body><article class="post comments-open"><p>a</p></article></body>', "a"),
        ('<body><form id="aspnetForm"><div class="menu"><p>m</p></div><div class="content"><p>a</p></div></form></body>', "a"),
        ('<body><div class="sidebar layout"><nav>n</nav><main><p>a longer text</p></main></div><div class="post"><p>b</p></div></body>', "a longer text"),
        ('<body><article><h2 id="related-work">R</h2><h3 id="search">S</h3><p id="warning-1">W</p><p class="copyright-law">C</p><div class="cookie-recipe">K</div><div class="cookie-notice">x</div><div class="site-footer">y</div><form><p>z</p></form></article></body>', "R\nS\nW\nC\nK"),
        ('<body><section class="comments"><article><p>c</p></article></section><div class="text"><p>no comment but a text</p></div></body>', "no comment but a text"),
    ],
)
def test_marks_that_are_no_boilerplate(spark, page, text):
    pages = spark.createDataFrame([(1, "http://h.example/1", page), (2, "http://h.example/2", page)], "page_id long, url string, html string")
    assert [r.text for r in w.extract(pages).collect()] == [text, text]


@pytest.mark.parametrize(
    "page",
    [
        '<body><article style="overflow:hidden"><p>Kept text.</p></article></body>',
        '<body><article style="overflow: hidden"><p>Kept text.</p></article></body>',
        '<body><article class="post no-comments"><p>Kept text.</p></article></body>',
        '<body><main class="content has-sidebar"><p>Kept text.</p></main></body>',
        '<body><article><p data-id="ad-17">Kept text.</p></article></body>',
        '<body><article id="search-for-meaning"><p>Kept text.</p></article></body>',
        "<body><article><address>Kept text.</address></article></body>",
        "<body><article><p><math><mi>Kept text.</mi></math></p></article></body>",
        "<body><article><p>Kept text.</p><p hidden>Lost.</p><p style='display: none'>Lost.</p></article></body>",
    ],
)
def test_articles_are_not_lost_to_a_word(spark, page):
    rows = w.extract(spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")).collect()
    assert [r.text for r in rows] == ["Kept text."]


def test_very_deep_pages(spark):
    began = time.time()
    page = "<body><article>" + "<div>" * 20000 + "Deep text." + "</div>" * 20000 + "</article></body>"
    assert w.main_text(page, {s for k, s, _ in w.stream(page) if k == "text"}) == "Deep text."
    assert time.time() - began < 60
