"""Extraction of main text: blocks by markup, labels by rules, and whole pages of several layouts with known articles."""

from __future__ import annotations

import html
import re
import time

import pytest

from ledgerlift.llm import html_blocks as hb
from ledgerlift.llm import queries

SF = "/root/testdata/sf0.01"
LONG = "This is a sentence that was written for the test of this and that, and it has to be as long as one of the paragraphs that are in an article of the web, so that it is told from the menus and the lists that are around it and from all of the rest of a page."
MORE = "It is on the other side of the page that the second of the paragraphs is to be found, with a <a href='/x'>link</a> in it that is as short as it was in the first of them, and with all of the words that make it look like the text of an article that was written by one of us."
PLAIN_MORE = re.sub("<[^>]*>", "", MORE)
ROWS = " | ".join(f"item{i} {i * 7}" for i in range(40))
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain words", ""),
        (LONG, LONG),
        (f"<nav>{MENU}</nav><article><h1>Title</h1><p>{LONG}<p>{MORE}<p>Short end.</article><footer>&copy; us. {LONG}</footer>", f"Title\n\n{LONG}\n\n{PLAIN_MORE}\n\nShort end."),
        (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><p>Tail.</p></article><section id=comments><article class='comment'>{LONG}</article></section>", f"{LONG}\n\nTail."),
        (f"<article><p>{ROWS}</p><p>Of.</p></article>", f"{ROWS}\n\nOf."),
        (f"<div class=menu>{MENU}</div><div><p>{LONG}</p><p>{PLAIN_MORE}</p></div><div class='cookie-notice'>{LONG}</div><p>{ROWS}</p>", f"{LONG}\n\n{PLAIN_MORE}"),
        (f"<div>{MENU}<h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{PLAIN_MORE}</p><p><a href=/>Read on</a></p></div>", f"Head\n\n{LONG}\n\nShort.\n\n{PLAIN_MORE}"),
        (f"<body class='has-sidebar'><div class='with-sidebar'><article><p>{LONG}</article><div class=sidebar>{LONG}</div></div>", LONG),
        (f"<main><header><h1>T</h1></header><p>{LONG}<form><p>{LONG}</form><aside>{LONG}</aside><p hidden>{LONG}</p></main>", f"T\n\n{LONG}"),
        (f"<p>{LONG}<br>next line<br/><br> new&nbsp;block that has &lt;b&gt; &amp;amp; &#233;&#x20ac; in it", f"{LONG} next line\n\nnew block that has <b> &amp; é€ in it"),
        (f"<script>var t='</p>'; if (a < b) x()</script><style>p{{}}</style><!-- <p>{LONG}</p> --><article>{LONG}<!-- never ends", LONG),
        (f"<article><p title='a > b' class=x>{LONG} 3 < 4 and 5 > 2</p><p>cut <a href='/x", f"{LONG} 3 < 4 and 5 > 2\n\ncut"),
        (f"<table><tr><td>{LONG}<td>x</table><div class='main-nav'>{LONG}</div>", f"{LONG}\n\nx"),
        (f"<ARTICLE><P>{LONG}</P></ARTICLE><DIV CLASS='Ad'>{LONG}</DIV>", LONG),
        (f"<article><b>{LONG}<p>{PLAIN_MORE}</b></article>{LONG}", f"{LONG}\n\n{PLAIN_MORE}"),
    ],
)
def test_layouts(page, want):
    assert hb.main_text(page) == want


def test_labels_are_inherited_from_the_nearest():
    good, near, open_, bad = hb.GOOD, hb.NEAR, hb.OPEN, hb.BAD
    assert hb.in_context([bad, open_, open_, open_, good, near, bad], bad) == [bad, bad, good, good, good, good, bad]
    assert hb.in_context([open_, near], bad) == [bad, good] and hb.in_context([open_], good) == [good]
    assert hb.in_context([bad, near, bad, open_], bad) == [bad] * 4


def test_work_is_in_proportion_to_length():
    for piece in ("<", "<a ", "<p>x", "<!--", "</", "<b>", "&", '<p a="', "<div>x<br>", "<script>", "< p", "<a b='c'>x"):
        began = time.time()
        hb.main_text(piece * (2_000_000 // len(piece)))
        assert time.time() - began < 20, piece


def test_whole_pages(spark):
    """The supplied pages have one known layout: the article's blocks are its paragraphs and its heading."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op13_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S).group(1)
        told = [" ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*$", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(t for t in told if t) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_rows(spark):
    given = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", f"<article>{LONG}</article>", "y"), (3, "u", "", None)]
    pages = spark.createDataFrame(given, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, hb.extract(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", LONG, len(LONG)), (3, "u", "", 0)], key=str)
    assert hb.extract(pages.where("false")).count() == 0
