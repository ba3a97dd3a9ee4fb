"""Main text of hand-made pages."""

import numpy as np
import pytest

from veridoc.llm import htmltext as H

LONG = "This sentence of the article is long enough to have a ratio of its own, and it goes on for a while so that it does."
MORE = "A second paragraph, with <b>bold</b> and <a href='x'>linked</a> words &amp; &eacute;&#233;&#x20AC;, is text as well; it is no menu at all."
PLAIN_MORE = "A second paragraph, with bold and linked words & éé€, is text as well; it is no menu at all."
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(8)) + "</ul>"

CASES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><header><h1>Site</h1></header><div class='ad'>Buy {LONG}</div>"
                f"<article><h1>Title</h1><p>{LONG}<p>{MORE}</p><p>Short.</p></article><aside>Aside {LONG}</aside><footer>(c) {LONG}</footer></body>",
                f"Title {LONG} {PLAIN_MORE} Short."),
    "plain divs": (f"<body><div id='top-nav'>{MENU}</div><div class='content'><h2>Head</h2><p>{LONG}</p><p>Tiny</p><p>{MORE}</p></div>"
                   f"<div class=\"cookie-notice\">We use cookies. {LONG}</div><div id='comments'><p>First! {LONG}</p></div><script>var a='<p>x</p>';</script></body>",
                   f"Head {LONG} Tiny {PLAIN_MORE}"),
    "menu without a name": (f"<body><div>{MENU}</div><div><p>{LONG}</p><p>{MORE}</p></div></body>", f"{LONG} {PLAIN_MORE}"),
    "sections": (f"<main><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{MORE}</p><form>Name <input> {LONG}</form></section></main>"
                 f"<section class='commentList'><article><p>{LONG}</p></article></section>", f"One {LONG} Two {PLAIN_MORE}"),
    "unclosed": (f"<body><nav>{MENU}<article><p>{LONG}<p>{MORE}<ul><li>a<li>b</ul><p class=ad>Buy<br>now<p>end", f"{LONG} {PLAIN_MORE} a b end"),
    "header in article": (f"<header>Site {LONG}</header><article><header><h1>Title</h1></header><p>{LONG}</p><footer>Share {LONG}</footer></article>", f"Title {LONG}"),
    "class names": (f"<div class='layout with-sidebar'><div class='AD'>{LONG}</div><div id='mainMenu'>{MENU}</div><div class='story'><p>{LONG}</p>"
                    f"<div class='adBox'>{LONG}</div><p>{MORE}</p></div><div class='side col'><p>{LONG}</p></div></div>", f"{LONG} {PLAIN_MORE}"),
    "no tags": (" just  a\n text ", "just a text"),
    "empty": ("", ""),
    "null": (None, ""),
    "no text": ("<html><body><script>x()</script><!-- no --></body></html>", ""),
    "only boilerplate": (f"<nav>{MENU}</nav><footer>{LONG}</footer>", ""),
    "broken": ("<p>a < b && c <d <!-- open", None),
    "hidden": (f"<article><p>{LONG}</p><p hidden>{LONG}</p><div style='display: none'>{LONG}</div><p>a<br/>b</p></article>", f"{LONG} a b"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    got = H.main_text(html)
    assert want is None or got == want


NAMED = {
    "article in a named wrapper": (f"<body><nav>{MENU}</nav><div class='sticky-header'><article><p>{LONG}</p><p>{MORE}</p></article></div>"
                                   f"<div class='comments'><p>First! {LONG}</p></div></body>", f"{LONG} {PLAIN_MORE}"),
    "named layout": (f"<body><div class='layout footer-dark'><div id='search-results'><p>{LONG}</p><p>{MORE}</p><div class='ads'>Buy {LONG}</div></div></div></body>",
                     f"{LONG} {PLAIN_MORE}"),
    "ad-free": (f"<div class='ad-free'><p>{LONG}</p></div>", LONG),
    "only named parts": (f"<div class='promo'><p>{LONG}</p></div><div class='share'><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    "math and byline": (f"<article><p class='byline'>By A. Writer</p><p>{LONG} <math><mi>x</mi></math> is it.</p></article>", f"By A. Writer {LONG} x is it."),
    "comments beside the article": (f"<article><p>{LONG}</p><p>{MORE}</p></article><div class='comments'><article><p>First! {LONG}</p></article></div>",
                                    f"{LONG} {PLAIN_MORE}"),
    "named inside a line": (f"<p>{LONG} a<span class='ad'>Buy</span>b</p>", f"{LONG} ab"),
}


@pytest.mark.parametrize("name", NAMED)
def test_names_alone_do_not_drop_the_text(name):
    html, want = NAMED[name]
    assert H.main_text(html) == want


def test_long_page():
    body = "".join(f"<p>{LONG} {i}</p><p>x</p>" for i in range(4000))
    assert H.main_text(f"<nav>{MENU}</nav><article>{body}</article>") == " ".join(f"{LONG} {i} x" for i in range(4000))


def test_smoothing_keeps_level():
    assert np.allclose(H.smooth(np.full(9, 3.0)), 3.0) and np.allclose(H.smooth(np.array([2.0])), 2.0)


def test_pages(spark):
    rows = [(i, f"u{i}", html, "x", 1) for i, (html, _) in enumerate(CASES.values())] * 2 + [(None, None, "a", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = H.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, got.collect())) == sorted(
        str(got.sparkSession.createDataFrame([(i, u, H.main_text(h), len(H.main_text(h)))], got.schema).first()) for i, u, h, _, _ in rows)
    assert H.extract(pages.limit(0)).count() == 0
