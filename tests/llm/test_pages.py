"""Main text of pages: the scan against all runs, layouts of many kinds, malformed and very long pages."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tessera.llm import html
from tessera.llm.labelled_pages import FRAMES, labelled_pages

S = " ".join(["word"] * 30)

LAYOUTS = {
    "wrapper named after a sidebar": (f"<body><div class='content with-sidebar'><h1>Title here</h1><p>{S}</p><p>{S}</p></div><div class='footer'>foot it</div></body>", ["Title here", S, S]),
    "title in a part named header": (f"<nav><a href=/>Home</a></nav><article><div class='article-header'><h1>The title</h1></div><p>{S}</p></article>", ["The title", S]),
    "title named banner": (f"<nav><a href=/>Home</a></nav><article><h1 class='banner'>The title</h1><p>{S}</p></article>", ["The title", S]),
    "unclosed button": (f"<article><h1>The title</h1><p>{S}</p><button>Share<p>after {S}</p></article>", ["The title", S, f"after {S}"]),
    "unclosed button within a paragraph": (f"<div id=c><h1>The title</h1><p>{S}<button>Share</p><p>after {S}</p></div>", ["The title", S, f"after {S}"]),
    "unclosed object": (f"<article><h1>The title</h1><p>{S}</p><object data=x><p>after {S}</p></article>", ["The title", S, f"after {S}"]),
    "unclosed title": (f"<title>foo<body><article><h1>The title</h1><p>{S}</p></article>", ["The title", S]),
    "formula": (f"<article><h1>The title</h1><p>before <math><mi>x</mi></math> {S}</p></article>", ["The title", f"before x {S}"]),
    "two parts": (f"<nav><a href=/>Home</a></nav><article><h1>One</h1><p>{S}</p></article><div class='ad'>Buy this thing now</div><article><h2>Two</h2><p>{S} end</p></article><footer>foot</footer>", ["One", S, "Two", f"{S} end"]),
    "no names at all": (f"<html><body><h1>Title of it</h1><p>{S}</p><p>short one</p><p>{S}</p></body></html>", ["Title of it", S, "short one", S]),
    "one division": (f"<html><body><div>{S} {S}</div></body></html>", [f"{S} {S}"]),
    "long comments": (f"<body><header><h1>Site</h1></header><main><article><h1>Title of it</h1><p>{S}</p></article><section class='comments'><h2>Comments</h2><p>I {S} {S} {S}</p></section></main><aside>foo bar</aside></body>", ["Title of it", S]),
    "form within": (f"<body><div class='article'><h1>Title of it</h1><p>{S}</p><form><p>Sign up for the letter now please</p><input><button>Go</button></form><p>tail {S}</p></div></body>", ["Title of it", S, f"tail {S}"]),
    "named page": (f"<body><div id='page' class='has-sidebar'><div class='site-header'>Foo</div><div class='story-content'><h1>Title of it</h1><p>{S}</p></div><div class='sidebar'><p>foo {S}</p></div></div></body>", ["Title of it", S]),
    "notice": (f"<body><div id='cookie-banner'><p>cook {S}</p></div><div class=blog-post><h1>Title of it</h1><p>{S}</p><p>{S}</p></div><div class=copyright>Copyright</div></body>", ["Title of it", S, S]),
    "lists": (f"<body><nav><ul><li><a>a</a></li></ul></nav><article><h1>Ten things</h1><ul><li>one</li><li>two words</li><li><a href=x>link only</a></li></ul><p>{S}</p></article></body>", ["Ten things", "one", "two words", "link only", S]),
    "short": ("<body><nav><ul><li><a>a</a></li></ul></nav><article><p>One.</p></article><footer>f g h</footer></body>", ["One."]),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html.main_text(page).split("\n") == want


def test_labelled_pages_are_many_and_learned():
    pages = labelled_pages()
    assert len(pages) >= 40 and len({x for runs in pages for _, x in runs}) > 80
    w = html.weights()
    assert all(v < 0 for v in w.tags.values()) and w.elements["section article"] > 0 > w.elements["section nav"]


def left_out(pages, frames, frame):
    """(right, wrong, missed) words of the pages of one frame, by weights that are learned without that frame."""
    w = html.learn([runs for k, runs in enumerate(pages) if k % frames != frame])
    right = wrong = missed = 0
    for runs in pages[frame::frames]:
        want = html.main_text("".join(x for m, x in runs if m), html.Weights({}, {"": 100.0}, {}))
        got = html.main_text("".join(x for _, x in runs), w)
        n, m = len(got.split()), len(want.split())
        right, wrong, missed = right + min(n, m), wrong + max(0, n - m), missed + max(0, m - n)
    return right, wrong, missed


def test_layouts_that_are_left_out_are_told_apart():
    """Learned without any page of a layout, for each layout in turn, the weights find nearly all main words there and few others."""
    pages, frames = labelled_pages(), len(FRAMES)
    assert frames >= 40
    right, wrong, missed = np.sum([left_out(pages, frames, k) for k in range(frames)], axis=0)
    assert missed < 0.02 * right and wrong < 0.08 * right, (right, wrong, missed)


@pytest.mark.parametrize("links", [10, 300, 10_000])
@pytest.mark.parametrize("aside", ["<nav class=toc>{}</nav>", "<section class='related-posts'><ul>{}</ul></section>", "<aside class='promo'>{}</aside>"])
def test_asides_of_any_size_take_nothing_from_the_article(links, aside):
    inner = aside.format("<li><a href=x>link</a></li>" * links)
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{S}</p><p>{S}</p>{inner}<p>{S}</p><p>{S} end</p></article><footer>foot it</footer></body>"
    assert html.main_text(page).split("\n") == ["Title of it", S, S, S, f"{S} end"]


@pytest.mark.parametrize("entry", ["<div><b>Ann B</b><p>{}</p></div>", "<li class=q><i>Ann</i><p>{}</p></li>", "<section class=zz><p>Ann B</p><p>{}</p></section>"])
def test_unnamed_discussions_are_told_by_their_form(entry):
    said = "".join(entry.format("I say " + "word " * n) for n in (12, 30, 22, 18))
    page = f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>Title of it</h1><p>{S}</p><p>{S} {S}</p><p>{S}</p></div><div>{said}</div><div>foot it</div></body>"
    assert "I say" not in html.main_text(page) and html.main_text(page).startswith("Title of it\n" + S)


def test_best_run_is_the_best_of_all_runs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 20, 40):
        for _ in range(40):
            scores = [float(x) for x in rng.integers(-6, 6, n)]
            a, b = html.best_run(scores)
            sums = {(i, j): sum(scores[i:j]) for i in range(n) for j in range(i + 1, n + 1)}
            assert sum(scores[a:b]) == max([0.0, *sums.values()])
            best = [(j, -i) for (i, j), s in sums.items() if s == max(sums.values())]
            assert (a, b) == (0, 0) or (b, -a) == min(best)


@pytest.mark.parametrize("page", ["<a b='y" * 150_000, "<a b='y " * 100_000 + "<p>", "<div>" * 50_000 + "text", "<" * 1_000_000, "<!--" * 250_000, "<a>" * 50_000, "<p>" * 50_000 + "</b>" * 9000, "<div><b>" * 30_000 + "</b></div>" * 30_000, "<a " + "= " * 500_000, "<ul><li>" * 30_000, "<textarea>" * 50_000])
def test_malformed_pages_take_time_in_proportion(page):
    html.weights()
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 6


def test_markup_is_read_as_browsers_do():
    text = lambda page: html.main_text(page, html.Weights({}, {"": 100.0}, {}))
    assert text("<p title=\"a > b\">one</p>") == "one"
    assert text("<p title=it's>one</p><p>it's two") == "one\nit's two"
    assert text("a <!-- x > y --> b <!--> c <!DOCTYPE x> d <?x?> e </> f") == "a b c d e f"
    assert text("a < b &amp;&lt; c&nbsp;d &#x41;") == "a < b &< c d A"
    assert text("<script>if (a </b>) {}</script>x<style>p{}</style>y<script>cut off") == "xy"
    assert text("x<textarea>y</textarea>z<iframe>w</iframe>") == "xz"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert text("one<p") == "one"
