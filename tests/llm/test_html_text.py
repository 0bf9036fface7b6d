import numpy as np
import pytest

from hearthcheck.llm.html_text import blocks_of, decide, extract, main_text, trained

TREE = trained()
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1><p>A line about the site that is rather long and would pass as text by its words.</p></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div id="cookie-notice"><p>We use cookies to make this site
work better for all of you.</p></div><div class='ad'>Buy now</div>
<article class="post"><header><h1>Head &amp; line</h1></header><p><b>First   text &lt;b&gt;
here<br>goes on&nbsp;well.<p>Short.</p><!-- no > text --><p>With a <a href="x?a>b">link</a> inside.</p><noscript>no</noscript>
<form><p>Your name and address please, and then press the button below.</p></form>
<section class="comments"><p>A reader says that this is a very nice article, thanks for it all.</p></section></article>
<aside><p>A sidebar of quite some words that a count alone would take for text of the page.</p></aside>
<footer>&copy; someone</footer></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE, TREE) == "Head & line\nFirst text <b> here goes on well.\nShort.\nWith a link inside."


@pytest.mark.parametrize(
    "html, text",
    [("", ""), ("<p>", ""), ("a < b and c", "a < b and c"), ("<!-- x", ""), ("<script>x", ""), ("<article><p>one two<p>three &amp four", "one two\nthree & four"),
     ("<article><p>x" + "<div>" * 3_000 + "deep", "x\ndeep"), ("<article><p>" + "w " * 60_000, ("w " * 60_000).strip()), ("<nav>a</nav>", "")],
)
def test_odd_pages(html, text):
    assert main_text(html, TREE) == text


@pytest.mark.parametrize(
    "html, text",
    [("<html><head><title>x</title><meta charset=utf-8><body><article><p>One line of text here.</article>", "One line of text here."),
     ("<head><title>x</title><style>p{}</style><article><p>One line of text here.", "One line of text here."),
     ("<article class='post has-comments'><p>One line of text here.</article>", "One line of text here."),
     ("<main class='widget'><p>One line of text here.</main>", "One line of text here."),
     ("<div id='page' class='no-sidebar'><article><p>One line of text here.</article></div>", "One line of text here."),
     ("<div class='widget'><p>Name</p><article><p>One line of text here.</article></div>", "One line of text here."),
     ("<article><p>One line of text here.<div class='comments'><article class='comment'><p>I say so too.</article></div></article>", "One line of text here."),
     ("<article><p>One line of text here.</article><div class='site-footer'><p>A line about the owner of this site.</div>", "One line of text here.")],
)
def test_open_heads_and_names_around_articles_empty_no_page(html, text):
    assert text in main_text(html, TREE).split("\n") and "say so" not in main_text(html, TREE) and "owner" not in main_text(html, TREE)


def test_pages_table(make):
    rows = [(1, "u", PAGE, "t", 1), (1, "u", PAGE, "t", 1), (2, None, None, None, None), (None, "v", "", "t", 2)]
    table = make("page_id long, url string, html string, text string, n_chars long", *rows)
    got = sorted(((r.page_id or 0, r.n_chars, len(r.text)) for r in extract(table).collect()))
    assert got == [(0, 0, 0), (1, 72, 72), (1, 72, 72), (2, 0, 0)]
    assert extract(table.limit(0)).collect() == []


def test_tree_never_drops_prose_of_an_article_nor_keeps_furniture():
    pick = np.random.default_rng(1)
    n = 5_000

    def rows(article, furniture, most_links):
        near = [pick.integers(0, 200, n), pick.uniform(0, 1, n), pick.integers(0, 200, n), pick.uniform(0, 1, n), pick.integers(0, 2, n)]
        return np.c_[pick.integers(1, 300, n), pick.uniform(0, most_links, n), *near, np.full(n, article), np.full(n, furniture)]

    assert decide(TREE, rows(1, 0, 0.5)).all()
    assert not decide(TREE, rows(1, 1, 1)).any() and not decide(TREE, rows(0, 1, 1)).any()


def test_blocks_carry_their_features():
    found = blocks_of("<main><h2>A b</h2><ul><li><a>c</a> d</ul></main><div class='x sidebar'>e")
    assert found == [("A b", 2, 0, True, True, False), ("c d", 2, 1, False, True, False), ("e", 1, 0, False, False, True)]
