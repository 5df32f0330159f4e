"""HTML extraction: the whole table, made-up layouts, wrappers, odd rows."""

import html
import re

from conftest import SF_MID
from ringlens.llm import catalog, wrappers
from ringlens.llm.common import Scratch


def test_query_over_the_whole_table(spark):
    """The table's pages hold one article each; its blocks are read here with plain patterns."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    rows = catalog.op3_wrappers(spark, SF_MID).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(b for b in blocks if b)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


LAYOUT = """<html><body><div class="cookie-notice">We use cookies</div><header><a href=/>Site</a><nav><ul><li>A<li>B</ul></nav></header>
<div id="content"><h1>Title {i}</h1><p>First   para&nbsp;{i} &lt;b&gt; <b>bold</b><br>line<!-- no --></p>{more}<form><input value=x>Send</form>
<div class="ad">Buy!</div><script>var a = "<p>no</p>";</script><ul><li>one<li>two {i}</ul></div>
<aside>Side</aside><div class="comments"><p>Great post {i}, I liked it very much indeed, thanks a lot for it!</p></div><footer>(c) {i}</footer>"""


def test_layout_without_article(spark):
    rows = [(i, f"https://x.example.org/{i}", LAYOUT.format(i=i, more="<table><tr><td>cell</table>" if i % 3 == 0 else "")) for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in wrappers.extract_pages(df).collect():
        cell = "cell\n" if r.page_id % 3 == 0 else ""
        assert r.text == f"Title {r.page_id}\nFirst para {r.page_id} <b> bold line\n{cell}one\ntwo {r.page_id}"
    found = wrappers.infer_wrappers(df.selectExpr("'x' AS host", "html"), Scratch(spark, "test")).collect()
    assert len(found) == 1 and "(<table>" in wrappers.regular_expression(__import__("json").loads(found[0].wrapper))


def test_alignment_rules():
    of = lambda page: wrappers.expression(wrappers.parse(page))
    w = wrappers.merge(of("<div><h2>A</h2><p>x</p><p>y</p></div>"), of("<div><h2>A</h2><p>z</p><i>n</i></div>"))
    assert wrappers.regular_expression(w) == "<#root><div><h2>A(<p>#)+(<i>n)?"
    assert wrappers.regular_expression(of("<dl>" + "<dt>a<dd>b" * 4 + "</dl>")) == "<#root><dl>(<dt>a<dd>b)+"


def test_odd_rows(spark):
    deep = "<div>" * 5_000 + "<article><p>deep</p></article>"
    rows = [(1, None, None, 1), (2, "", "", 1), (3, "no url", "plain text", 1), (4, "http://h/", "<article><p>cut of", 1), (4, "http://h/", "<article><p>cut of", 1),
            (5, "http://h/2", "<article><h1>a</h1><p>" + "long " * 60_000 + "</p></article><script>x", 1), (6, "http://d/", deep, 1), (7, "http://h/3", "<nav>only</nav>", 1),
            (None, "http://h/4", "<article class='ad'><header><h1>T</h1>by me</header><div class='share'>s</div>&#65;&amp</article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = wrappers.extract_pages(df).collect()
    texts = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and texts[1] == texts[2] == "" and texts[3] == "plain text" and texts[4] == "cut of"
    assert texts[5] == "a\n" + ("long " * 60_000).strip() and texts[6] == "deep" and texts[7] == "" and texts[None] == "T\nA&"
    assert wrappers.extract_pages(df.limit(0)).count() == 0


def test_deep_elements_close_themselves_only(spark):
    """Nested elements and unquoted values with a slash at the end: nothing outside them is closed, nothing inside forgotten."""
    page = "<div id=page><article><p>head</p>" + "<div>" * 250 + "<nav>no</nav>in" + "</div>" * 250 + "<div data-base=/x/>mid</div><p>tail</p></article></div>"
    far = "<div>" * 20_000 + "<article><p>far</p></article>" + "</div>" * 20_000
    rows = [(1, "http://h/", page), (2, "http://h/", page), (3, "http://far/", far), (4, "http://far/", far)]
    out = wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {1: "head\nin\nmid\ntail", 2: "head\nin\nmid\ntail", 3: "far", 4: "far"}
    assert not wrappers._UNQUOTED_END.search(' name="a"/') and not wrappers._UNQUOTED_END.search(" /")


def test_names_of_headings_and_ids_drop_nothing(spark):
    page = """<body><div class="ad">Buy</div><article><h2 id="related-work">Related work</h2><p class="notice" id="reply-rates">Reply <span class="search">rates</span></p>
<section id="ad-hoc-networks"><h3 class="social">Social</h3>Networks <math><mi>x</mi><mo>=</mo><mn>1</mn></math> end</section><div class="share">Share</div></article></body>"""
    other = """<body><div id="content"><h2 id="search-methods">Search</h2><div id="menu-costs">Menu costs</div></div><div class="menu">No</div></body>"""
    rows = [(1, "http://h/", page), (2, "http://h/", page), (3, "http://o/", other)]
    out = wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "Related work\nReply rates\nSocial\nNetworks x=1 end"
    assert {r.page_id: r.text for r in out} == {1: text, 2: text, 3: "Search\nMenu costs"}


def test_fixed_groups_of_a_host_are_not_read(spark):
    """The same box and link list on every page, without a telling class; a fixed heading and copies of a page stay."""
    box = '<div class="box-17"><p>Read our letter.</p></div>'
    page = "<body><div id=content><h2>Abstract</h2><p>Text {i} of the host, long enough to be most of the page.</p>" + box + '<ul class=x><li><a href=/a>A</a><li><a href=/b>B</a></ul></div></body>'
    copy = "<body><article><h1>One</h1><div><p>The same text on each.</p></div></article></body>"
    rows = [(i, "http://many/", page.format(i=i)) for i in range(30)] + [(100 + i, "http://few/", page.format(i=i)) for i in range(3)]
    rows += [(200 + i, "http://copies/", copy) for i in range(20)]
    texts = {r.page_id: r.text for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    main = "Abstract\nText {i} of the host, long enough to be most of the page."
    assert all(texts[i] == main.format(i=i) for i in range(30))
    assert all(texts[100 + i] == main.format(i=i) + "\nRead our letter.\nA\nB" for i in range(3))
    assert all(texts[200 + i] == "One\nThe same text on each." for i in range(20))


def test_prose_of_an_article_stays_on_every_host(spark):
    """The last section of an article is the same on all pages of a host: prose and headings stay, link lists go."""
    page = ("<body><article><p>Own text {i} of this page.</p><section><h2>Method</h2><p>The same on every page.</p></section>"
            "<div><p>Read our letter, it is the same everywhere.</p></div><ul><li><a href=/a>More of A</a><li><a href=/b>More of B</a></ul></article></body>")
    rows = [(i, "https://same.org/p", page.format(i=i)) for i in range(12)]
    got = wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {
        i: f"Own text {i} of this page.\nMethod\nThe same on every page.\nRead our letter, it is the same everywhere." for i in range(12)}
