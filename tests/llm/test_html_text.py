"""The tree decides by neighbours, pages without an article element, and broken pages in linear time."""

import time

import pytest

from tessera.llm import html_text

LONG = " ".join(f"word{k}" for k in range(60))


def used(node):
    return set() if isinstance(node, bool) else {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3])


def test_the_tree_uses_neighbours():
    assert {"words before", "density before", "words after", "density after"} <= used(html_text.TREE)
    for row in html_text.labelled_rows():
        node = html_text.TREE
        while not isinstance(node, bool):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        assert node == bool(row[-1])


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><div><a href=a>Home</a></div><div><a href=b>News</a></div><h1>Title here</h1><p>{LONG}<p>Short one.<p>{LONG}<div><a href=c>Next</a></div><div><a href=d>Up</a></div></body>", f"Title here {LONG} Short one. {LONG}"),
        (f"<h1>Title here</h1><p>{LONG}</p><h3>3 Comments</h3><p>Bob</p><p>{LONG}</p>", f"Title here {LONG}"),
        (f"<article><header><h1>Title</h1><h2>Subheading</h2></header><p>{LONG}</p><section class=legal><p>{LONG}</p></section><p>end</p></article>", f"Title Subheading {LONG} {LONG} end"),
        (f"<header><a href=a>Site</a><p>A tagline</p></header><ul><li><a href=b>x</a><li><a href=c>y</a></ul><p>{LONG}</p>", LONG),
        (f"<p>{LONG}</p><h2>More of this</h2><ul><li><a href=a>One two</a><li><a href=b>Three</a></ul>", LONG),
        (f"<article><p>{LONG}</p><div class='cookie-notice'>We use cookies</div><form><p>mail</form><p>z</p></article>", f"{LONG} z"),
        (f"<article><div/>{LONG}<p>a <a href=x/>b</a></p></article>", f"{LONG} a b"),
        ('<article><p title="a > b">x</p><p class="open>y</p></article>', "x y"),
        ("<article>1 < 2 &lt; 3 <!-- no > yes --> end</article><!-- open", "1 < 2 < 3 end"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<p>", "<div \"'>", "<", "<!--", "<b><p>x", "</b>", "&amp;", "<script>", '<i class="a">'])
def test_long_broken_pages(piece):
    start = time.time()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    short = time.time() - start
    assert short < 15
