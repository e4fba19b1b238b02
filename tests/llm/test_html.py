from __future__ import annotations

import html as codec
import re
import time

import pytest

from barloom.llm import html

PROSE = "The first paragraph has enough words, commas, and length to count as prose in this page."
OTHER = "A second paragraph follows, with an &eacute; and an &amp; sign, so references are decoded too."
MORE = "Short end."


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    rows = {r.page_id: r for r in html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for p in pages:
        body = re.search(r"<article>(.*)</article>", p.html, re.DOTALL)[1]
        lines = [" ".join(codec.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert rows[p.page_id].text == "\n".join(x for x in lines if x)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)


WANT = "\n".join(["Title", PROSE, OTHER.replace("&eacute;", "é").replace("&amp;", "&"), MORE])


@pytest.mark.parametrize("page", [
    f"<body><header>Site</header><nav><a href=/>Home</a></nav><main><h1>Title</h1><p>{PROSE}</p><p>{OTHER}<p>{MORE}</main><aside>Side, with, commas, and words enough to be a paragraph.</aside><footer>(c)</footer>",
    f"<div id='menu-top'><ul><li><a href=a>A, B, C, D and more words of a menu entry</a></ul></div><div class=post><h1>Title</h1>\n<p>{PROSE}</p><div class='ad-slot'><p>Buy this, buy that, buy it now, everybody buys, it is cheap.</p></div><p>{OTHER}</p><p>{MORE}</p></div><div class='comments'><p>First!, I say, what a nice text this is, thank you all.</p></div>",
    f"<article><header><h1>Title</h1></header><p>{PROSE}</p><form><input><p>Subscribe, now, to our, letter, please, it is free of charge.</p></form><script>var x = '<p>no, no, no, no, no, no, no</p>';</script><p>{OTHER}</p><style>p{{}}</style><p>{MORE}</p><!-- <p>hidden, hidden, hidden, hidden, hidden, hidden</p> --></article><section class='cookie-notice'><p>We use cookies, as everyone does, please accept them all.</p></section>",
    f"<table><tr><td class=sidebar>Links, links, links, links, links, links, links</td><td><h1>Title</h1><p>{PROSE}<p>{OTHER}<p>{MORE}</td></tr></table>",
])
def test_layouts(page):
    assert html.main_text(page) == WANT


LONG = f"{PROSE} {PROSE} {PROSE}"


@pytest.mark.parametrize("page", [
    f"<div class=post><h1>Title</h1><div class=entry-content><p>{LONG}</p><p>{LONG}</p></div><ul><li>One item</li></ul></div>",
    f"<article><h1>Title</h1><section>{f'<p>{LONG}</p>' * 2}</section><section><ul><li>One item</ul></section></article>",
    f"<div><ul><li><a href=/>Home</a></ul><div><div><h2>Title</h2></div><div><p>{LONG}<p>{LONG}</div><table><tr><td>One item</table></div></div><div>Site words</div>",
])
def test_nested_layouts_stay_whole(page):
    assert html.main_text(page) == "\n".join(["Title", LONG, LONG, "One item"])


def test_ids_made_from_titles_stay():
    page = f"<article><h2 id=related-work>Title</h2><p id='notice-period'>{LONG}</p><section id=discussion><p>{LONG}</p></section><ul><li id=social-history>One item</ul><div class=comments><p>First!</p></div></article>"
    assert html.main_text(page) == "\n".join(["Title", LONG, LONG, "One item"])
    assert html.main_text(f"<div><h2 id=related-work>Title</h2><p id=notice-period>{LONG}</p></div><div id=comments><p>{PROSE}</p></div>") == f"Title\n{LONG}"


@pytest.mark.parametrize("page, want", [
    (f"<div class='elementor-widget-wrap'><h1>Title</h1><p>{LONG}</p><p>{OTHER}</p></div><div class=widget><p>{PROSE}</p></div>", None),
    (f"<div class='content has-sidebar'><h1>Title</h1><p>{LONG}</p><p>{OTHER}</p></div><div class=sidebar><p>{PROSE}</p></div>", None),
    (f"<article><h1>Title</h1><p class='share-price'>{LONG}</p><p>{OTHER}</p></article>", None),
    (f"<article><h1>Title</h1><p>{LONG}</p><p>{OTHER}</p><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><label>Last</label></article>", "One\nTwo\nLast"),
    (f"<div class=post><h1>Title</h1><p>{LONG}</p><p>{OTHER}</p></div><div class=comments>{f'<p>{LONG}</p>' * 9}</div>", None),
])
def test_names_alone_dont_remove_an_article(page, want):
    assert html.main_text(page) == "\n".join(x for x in ["Title", LONG, OTHER.replace("&eacute;", "é").replace("&amp;", "&"), want] if x)


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a href=\"x " * 100_000, "<p>" + "<a b='c>" * 120_000, "<div>" * 9000 + "</span>" * 120_000, "<b><td>" + "<i>" * 9000 + "</b>" * 250_000, "<div>" * 200_000, "<!" * 500_000, "</" * 500_000,
])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 8


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<p>x &lt;b&gt; &#233; &nope; y</p>", "x <b> é &nope; y"), ("<script>alert(1)", ""), ("< not a tag", "< not a tag"),
    ("<div hidden>gone</div><p>here</p>", "here"), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<p>a<br>b</p>", "a b"),
])
def test_small_and_broken_pages(page, want):
    assert html.main_text(page) == want


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + f"<p>{PROSE}</p>" + "</div>" * 5000
    assert html.main_text(deep) == PROSE
    long = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    assert html.main_text(long).count("\n") == 4999
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", f"<p>{PROSE}", "y"), (2, "u", f"<p>{PROSE}", "y")], "page_id long, url string, html string, text string")
    rows = html.extract(df).orderBy("page_id").collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in rows] == [(1, None, "", 0)] + [(2, "u", PROSE, len(PROSE))] * 2
    assert html.extract(df.limit(0)).count() == 0
