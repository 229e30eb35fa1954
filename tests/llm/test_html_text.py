"""Main texts of small pages, and the query's row for every page."""

import re
import time

import pytest

from lethe.llm import html_text, queries

from .frames import DATA

LONG = "This sentence of the article is long enough to carry the page by itself, with words and more words. "


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Short &amp; sweet&nbsp;end.</p></article><footer>(c)</footer></body>", f"Title {LONG.strip()} Short & sweet end."),
        (f"<main><p>{LONG}<p>Next <b>bold</b>\n  text</main><div class='comments'><p>{LONG}</p></div>", f"{LONG.strip()} Next bold text"),
        (f"<article><p>{LONG}</p><script>var a = '<p>no</p>';</script><style>p {{}}</style><form><input value=x>Sign</form><p>End.</p></article>", f"{LONG.strip()} End."),
        (f"<article><p>{LONG}</p><div class=\"ad-banner ad\">Buy</div><aside>More</aside><!-- hidden <p>no</p> --><p>Tail</p></article>", f"{LONG.strip()} Tail"),
        (f"<div id=menu><a>One</a><a>Two</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div class='cookie notice'>{LONG}</div>", f"{LONG.strip()} {LONG.strip()}"),
        (f"<article><p>{LONG}</p><!-- never closed <p>{LONG}</p>", LONG.strip()),
        (f"<article><p>{LONG}</p><p>5 &lt; 6 &#8212; caf&eacute; &#x41;</p></article>", f"{LONG.strip()} 5 < 6 — café A"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<main><p>{LONG}</p>" + "<p><a href=x>Read this next</a></p>" * 5 + f"<p>{LONG}</p>" + "<p><a href=x>More</a></p>" * 5 + "</main>", f"{LONG.strip()} {LONG.strip()}"),
        (f"<article><p>{LONG}</p></article><p>between</p><article><p>{LONG}{LONG}</p></article>", f"{LONG}{LONG}{LONG.strip()}"),
        (f"<article><p>A short note.</p></article><article><p>{LONG}</p></article>", f"A short note. {LONG.strip()}"),
        ("<div><p>A short page.</p></div>", "A short page."),
    ],
)
def test_windows_judge_marked_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("many", ["<li><a href=x>Item" * 101, "<font>" * 201, "<b>Item" * 5000])
def test_closing_tags_find_their_element_at_any_depth(many):
    assert html_text.main_text(f"<nav>{many}</nav><article><p>{LONG}</p></article>") == LONG.strip()
    assert html_text.main_text(f"<article><p>{LONG}</p>{many.replace('Item', '')}</article><p>{LONG}</p>") == LONG.strip()


@pytest.mark.parametrize(
    "before, after",
    [
        ('<div class="content-sidebar-wrap"><main>', "</main></div>"), ('<div class="layout no-sidebar"><article>', "</article></div>"), ('<article class="post has-sidebar">', "</article>"),
        ('<section id="legal-news"><article>', "</article></section>"), ('<article class="related-work">', "</article>"), ("<div class=sidebar><article>", "</article></div>"),
        ("<div class='left-sidebar'><div id=search><main>", "</main></div></div>"), ("<article class=notice>", "</article>"), ("<div class=overlay>", "</div>"), ("<form id=aspnet><main>", "</main></form>"),
        ("<main><h1></h1><div class=sidebar-wrap><article>", "</article></div></main>"), ('<section class="legal-news">', "</section>"),
    ],
)
def test_wrappers_of_the_main_text_stay(before, after):
    unwanted = "".join(f'<div class="{c}"><p>Not this.</p></div>' for c in ("sidebar", "site-footer", "col ad-banner", "comments-area", "cookie_notice"))
    assert html_text.main_text(f"<body>{unwanted}{before}<p>{LONG}</p><p>{LONG}</p>{after}{unwanted}</body>") == f"{LONG}{LONG.strip()}"


@pytest.mark.parametrize("quote", "\"'")
@pytest.mark.parametrize("size", [10, 4096, 5000, 300_000])
def test_quoted_values_of_any_length(quote, size):
    value = "<svg><p>no</p>" + "x" * size + "<article>"
    assert html_text.main_text(f"<article><p>{LONG}</p><div data-x={quote}{value}{quote}>End.</div></article>") == f"{LONG.strip()} End."
    assert html_text.main_text(f"<article><p class={quote}x>{LONG}</p>{'y' * size}</article>") == f"{LONG.strip()} {'y' * size}"


@pytest.mark.parametrize("piece", ["<a ", "<a '", "<a '><b \"", "<a '>' \"", "<!", "</", "<p class='x>"])
def test_broken_tags_take_linear_time(piece):
    start = time.process_time()
    html_text.main_text(piece * 100_000)
    html_text.main_text("<p>" + piece * 100_000 + '"' + ">")
    assert time.process_time() - start < 10


def test_long_broken_page():
    page = "<div><p class='" * 20000 + "<article>" + f"<p>{LONG}" * 2000
    assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").count("sentence") == 5000


def test_tables(spark):
    page = f"<article><p>{LONG}</p></article>"
    frame = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    rows = html_text.extract(frame).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows) == [(1, LONG.strip(), len(LONG.strip()))] * 2 + [(2, "", 0)]
    assert html_text.extract(frame.where("page_id > 5")).count() == 0


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.op6_html_text(spark, DATA).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["text"] == html_text.main_text(pages[r["page_id"]]["html"]) and r["url"] == pages[r["page_id"]]["url"]
        assert r["text"] == re.sub(r"\s+", " ", r["text"]).strip()
