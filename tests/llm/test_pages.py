from __future__ import annotations

import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from haltline.llm.line_blocks import WINDOW, extract_main_text, main_text, text_regions

PAGE_FILE = "/root/testdata/sf0.001/pages.parquet"
#: Of the given pages so many have the same text if their article is a nameless element.
SAME_SHARE = 1.0

PAGES = {
    "article": (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- x --><div class='ad'>Buy now.</div>"
        "<article><h1>One &amp; two</h1><p>A  <b>bold</b>\nword.<p>Short.<div class=advert>AD</div><p>&lt;End&gt;"
        "</article><section id='comments'><article>So true</article></section><footer>&copy; us</footer>",
        "One & two A bold word. Short. <End>",
    ),
    "no article": (
        "<div><a href=a>home</a> <a href=b>news</a></div><div id=main><p>" + "text " * 30 + "</p><p>Hi.</p></div>"
        "<aside>" + "side " * 90 + "</aside><form>name <input></form><div>tiny</div>",
        ("text " * 30).strip() + " Hi.",
    ),
    "cut off": ("<article><p>Kept &am", "Kept &am"),
    "cut in a script": ("<article><p>x<script>if(a<b)</scr", "x"),
    "unclosed parts": ("<main><p class=notice>cookies<p>Text<p><b>more<br>lines<ul><li>a<li>b</ul></main>", "Text more lines a b"),
    "inner header": ("<article><header>by me</header><p>Body</p><footer>tags</footer></article>", "Body"),
    "plain": ("just text 1 < 3 & more", "just text 1 < 3 & more"),
    "hidden": ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    "nothing": ("<nav><a href=x>only</a></nav>", ""),
    "empty": ("", ""),
    "no html": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_article_of_a_page(name):
    html, want = PAGES[name]
    assert main_text(html or "") == want


LONG = ("text " * 200).strip()
WHOLE = {
    "advert inside": (
        f"<body><div id=content><p>{LONG}</p><div class=ad>Buy</div><p>Short last.</p></div><div>tiny</div></body>",
        f"{LONG} Short last.",
    ),
    "advert in the body": (f"<body><p>{LONG}<div class=ad>Buy</div><p>Short last.</body>", f"{LONG} Short last."),
    "a link as paragraph": (
        f"<div><a href=a>home</a> <a href=b>news</a></div><div><p>{LONG}</p><p><a href=x>The whole report</a></p>"
        "<p>End.</p></div>",
        f"{LONG} The whole report End.",
    ),
    "states of a wrapper": (
        f"<div class='content has-sidebar'><div class='post no-comments' id=ad-free><p>{LONG}</p></div></div>"
        "<div class='site-footer'>us</div><div id=main-nav>go</div><div class=ad-slot>Buy</div>",
        LONG,
    ),
}


@pytest.mark.parametrize("name", WHOLE)
def test_no_part_of_the_main_text_goes(name):
    html, want = WHOLE[name]
    assert main_text(html) == want


def test_long_page():
    body = "<p>é word</p>" * 40_000
    assert main_text(f"<article>{body}</article><footer>f") == " ".join(["é word"] * 40_000)


def test_surge_and_dive():
    assert text_regions(np.array([0, 0, 0])) == []
    assert text_regions(np.array([5])) == [(0, 1)]
    assert text_regions(np.array([0, 5, 0, 2, 0, 0, 0, 9, 1])) == [(1, 4), (7, 9)]


def test_every_page_has_a_row(spark):
    rows = [(n, f"u{n}", html, "clash", 1) for n, (html, _) in enumerate(PAGES.values())]
    rows += [(None, None, PAGES["article"][0], None, None), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    want = [(n, f"u{n}", text, len(text)) for n, (_, text) in enumerate(PAGES.values())]
    want += [(None, None, want[0][2], want[0][3]), want[0]]
    got = [tuple(r) for r in extract_main_text(pages).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert extract_main_text(pages.limit(0)).count() == 0


def naive_regions(sizes):
    """Regions by looking at every window of lines."""
    found, begin = [], None
    for at in range(len(sizes) + WINDOW):
        full = any(sizes[max(0, at - WINDOW + 1) : at + 1])
        if full and begin is None:
            begin = at
        if not full and begin is not None:
            found.append((begin, at - WINDOW + 1))
            begin = None
    return found


def test_regions_equal_a_look_at_every_window():
    rng = np.random.default_rng(7)
    for _ in range(300):
        sizes = rng.integers(0, 9, rng.integers(0, 40)) * rng.integers(0, 2, 1) * (rng.random() < 0.9)
        sizes = np.where(rng.random(len(sizes)) < rng.random(), 0, sizes)
        assert text_regions(sizes) == naive_regions(sizes)


def test_the_largest_region_decides_not_the_element():
    teaser = "<main><p>Read on.</p></main>"
    story = f"<div class=story><p>{LONG}</p><div class=ad>Buy</div><p>Short last.</p></div>"
    assert main_text(f"<body>{teaser}<div class=ad>Buy</div>{story}</body>") == f"{LONG} Short last."
    # An article needs no more than a quarter of what stands beside it.
    third = ("text " * 60).strip()
    page = f"<body><article><p>{third}</p></article><div class=ad>Buy</div><div><p>{LONG}</p></div></body>"
    assert main_text(page) == third


@pytest.mark.skipif(not os.path.exists(PAGE_FILE), reason="needs the given tables")
def test_given_pages_without_article_elements_keep_their_text():
    pages = pq.read_table(PAGE_FILE, columns=["html"]).column("html").to_pylist()
    same = [main_text(page) == main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", page)) for page in pages]
    assert np.mean(same) >= SAME_SHARE
