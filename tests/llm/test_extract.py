"""Main text of pages with and without the marks of good markup."""

import html
import re

import pytest

from tests.llm.helpers import SF
from tickweave.llm import queries
from tickweave.llm.extract import extract_text, main_text

LONG = "The quick brown fox jumps over the lazy dog, again and again, until the evening comes."


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""), ("<html><body></body></html>", ""), ("plain text only", "plain text only"), ("<p>one<p>two", "one\ntwo"),
        (f"<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; me</footer>", f"T & U\n{LONG}\nShort."),
        (f"<div class='ad'>{LONG}</div><article><p>a  b\n c<br>d</p></article>", "a b c d"),
        (f"<div class='ad'>{LONG}<article><p>never closed</p></article>", "never closed"),
        (f"<main><p>{LONG}</p><aside>{LONG}</aside><section id='comments'><article><p>{LONG}</p></article></section></main>", LONG),
        (f"<script>var a='<p>x</p>';</script><style>p{{}}</style><article><p>{LONG}</p><form>Name <input> <button>Go</button></form></article>", LONG),
        (f"<article><header><h1>Title</h1></header><p><b>{LONG}<br><p>Next</p></article>", f"Title\n{LONG}\nNext"),
        (f"<body><div id='top'><a href=x>Home</a> <a href=y>News</a></div><div id='content'><h1>Head</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div>"
         f"<div><a>u</a><a>v</a></div></body>", f"Head\n{LONG}\nYes.\n{LONG}"),
        (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", f"{LONG}\none\ntwo\na\nb"),
        ("<article><p>&#233;&eacute;&nbsp;&am &lt;b&gt;</p></article", "éé &am <b>"),
        # a teaser in an article element isn't the article
        (f"<div id=story><h1>Head</h1>" + f"<p>{LONG}</p>" * 6 + f"</div><article class=teaser><h2>Teaser</h2><p>{LONG}</p></article>", "\n".join(["Head", *[LONG] * 6])),
        # names of parts of the article say nothing about it
        (f"<article><h2 id='related-work'>Related</h2><p>{LONG}</p><h2 id='search-algorithms'>Search</h2><section id='discussion'><p>{LONG}</p></section>"
         f"<p class='share-price'>Up 3 %.</p><section class='legal-framework'><p>Law.</p></section></article>",
         f"Related\n{LONG}\nSearch\n{LONG}\nUp 3 %.\nLaw."),
        # whole names do
        (f"<article><p>{LONG}</p><div class='social-share'>Share this</div><div class='related-posts'>More</div><div id='comments'><p>{LONG}</p></div>"
         f"<ul class='tags links'><li>a</ul></article>", LONG),
        (f"<article><p>{LONG}</p></article><ol class=commentlist><li><article><p>First!</p></article></ol>", LONG),
        # no article or main: the part with the text, without what stands around it
        (f"<div><ul><li><a>Home</a><li><a>News</a></ul></div><table><tr><td><a>x</a><td><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></table>"
         f"<div class=footer>Imprint {LONG}</div>", f"Head\n{LONG}\n{LONG}\nEnd."),
        (f"<div class='cookie-notice'>{LONG}</div><article><p>ok</p><div class='reader comments'>{LONG}</div></article>", "ok"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_long_and_deep():
    assert main_text("<article>" + "<div>" * 3000 + "<p>x</p>" + "</div>" * 3000 + f"<p>{'word ' * 500_000}</p></article>").startswith("x\nword word")


def test_operator_odd_rows(spark):
    rows = [(1, "u", None, "t", 1), (None, None, "<p>x</p>", "t", 2), (1, "u", "", "t", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, extract_text(pages).collect()), key=str) == sorted([(1, "u", ""), (None, None, "x"), (1, "u", "")], key=str)
    assert extract_text(pages.limit(0)).count() == 0


def test_query_against_the_article_element(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op9_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r.text == "\n".join(t for t in texts if t) and r.n_chars == len(r.text)
