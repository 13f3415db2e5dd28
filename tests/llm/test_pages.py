"""Main text of pages: blocks, the cut, and edge cases."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from eventfold.llm import extraction
from eventfold.llm.blocks import blocks
from eventfold.llm.common import table
from eventfold.llm.extraction import FIRST, features, labels, learned, links, main_text, minimum_cut


def shown(page):
    return [b.text for b in blocks(page)]


def test_blocks_follow_elements():
    assert shown("<p>one <b>two</b><br>three</p><div>four<p>five<p>six</div>seven") == [
        "one two three", "four", "five", "six", "seven"
    ]
    assert shown("<ul><li>a<li>b <i>c</i></ul>") == ["a", "b c"]
    assert shown("a &lt;b&gt; &amp;amp; &#233;&nbsp;&nbsp;x") == ["a <b> &amp; é x"]


def test_what_is_no_text():
    page = "<!-- <p>no</p> --><script>var a='<p>no</p>'</script><style>p{}</style><p>yes</p><textarea><p>no</textarea>"
    assert shown(page) == ["yes"]
    assert shown("<script>never closed <p>x</p>") == []
    assert shown("<title>t</title><noscript><p>no</p></noscript>") == []


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<p class='", "</p>", "a < b > c", "<!--", "&", "</", "<a<b>c"])
def test_unfinished_markup(page):
    blocks(page)


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("<head><meta x><body><article><p>one</p></article>", ["one"]),
        ("<head><title>t</title><link><p>one</p>", ["one"]),
        ("<svg/><article><p>one <svg/>two</p></article><svg></svg>", ["one two"]),
        ("<article><p>one <svg><path/><text>x</text></svg>two <button>y</button>three</p></article>", ["one two three"]),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", ["let x=1 be"]),
        ("<svg><path><article><p>one</p></article>", ["one"]),
        ("<button>Go<article><p>one</p></article>", ["Go", "one"]),
        ("<datalist><option>a<option>b</datalist><article><p>one</p></article>", ["a", "b", "one"]),
        ("<noscript><article><p>one</p></article>", ["one"]),
        ("<iframe src=x><article><p>one</p></article>", ["one"]),
        ("<video><article><p>one</p></article>", ["one"]),
    ],
)
def test_elements_left_open_or_closed_at_once(page, lines):
    assert shown(page) == lines
    if "<article>" in page:
        assert main_text(page, FIRST) == "\n".join(x for x in lines if x not in ("Go", "a", "b"))


ARTICLE = "<article><h1>Title</h1><p>First, a paragraph of some words.</p><p>Second one, as long as that.</p></article>"
AROUND = {
    "nav": "<nav><ul><li><a href='/'>Home</a></li></ul></nav>",
    "header": "<header><p>Name of the site.</p></header>",
    "footer": "<footer><p>All rights reserved, of course, by us.</p></footer>",
    "aside": "<aside><p>Read this too, it is long enough to look like text.</p></aside>",
    "ad": "<div class='ad'>Buy this, it is good, and cheap, and new.</div>",
    "form": "<form><label>Mail</label><input><p>Leave your address here, please.</p></form>",
    "cookie": "<div id='cookie-notice'><p>We use cookies, as everyone does, all the time.</p></div>",
    "comments": "<section class='comments'><article><p>I say, this is a comment, and a long one.</p></article></section>",
}


@pytest.mark.parametrize("order", list(itertools.permutations(AROUND, 2))[::5])
def test_an_article_without_what_is_around_it(order):
    before, after = (AROUND[k] for k in order)
    page = f"<html><body>{before}{ARTICLE}{after}</body></html>"
    assert main_text(page, FIRST) == (
        "Title\nFirst, a paragraph of some words.\nSecond one, as long as that."
    )


def test_what_is_inside_an_article_and_not_of_it():
    inside = "".join(AROUND[k] for k in ("aside", "ad", "comments"))
    page = f"<article><p>Before all that, some words.</p>{inside}<p>After all that, some more.</p></article>"
    assert main_text(page, FIRST) == "Before all that, some words.\nAfter all that, some more."


def test_a_page_without_names_of_parts():
    text = "This is a sentence of a text, with a comma, and it goes on for a while until it ends. " * 3
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8))
    page = f"<body><ul>{links}</ul><div><p>{text}</p><p>Short.</p><p>{text}</p></div></body>"
    got = main_text(page, FIRST).split("\n")
    assert got == [text.strip(), "Short.", text.strip()]


LONG = "This is a sentence of a text, with a comma, and it goes on for a while until it ends. "


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        # Names that hold a word of boilerplate among others, around text that reads like content.
        (f"<main><section id='notice-of-meeting'><p>{LONG * 2}</p></section></main>", [LONG * 2]),
        (f"<div class='story'><div class='social-history'><p>{LONG * 2}</p></div></div>", [LONG * 2]),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>", ["Title", LONG]),
    ],
)
def test_words_of_a_name_do_not_settle_it(page, lines):
    assert main_text(page) == "\n".join(x.strip() for x in lines)


def test_the_cut_overrules_the_classifier_both_ways():
    def shown_and_cut(page):
        found = blocks(page)
        x = np.array([features(b) for b in found])
        return {b.text: (gain > 0, kept) for b, gain, kept in zip(found, x @ FIRST[0], labels(x, links(found), FIRST))}

    page = f"<div><p>{LONG}</p><div>And so on</div><p>{LONG}</p></div>"
    assert shown_and_cut(page)["And so on"] == (False, True)
    items = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(4))
    page = f"<ul>{items}<li>Read on, here, now, or later.</li>{items}</ul>"
    assert shown_and_cut(page)["Read on, here, now, or later."] == (True, False)


def test_weights_follow_the_pages():
    """A name that the prior knows nothing of in the text takes its side from what it holds."""
    page = "<body><div class='entry'>" + f"<p>{LONG}</p>" * 4 + "</div>" + "<ul>" + "<li><a>Go there</a></li>" * 6 + "</ul></body>"
    found = blocks(page)
    sample = [(np.array([features(b) for b in found]), links(found))] * 20
    weights, cost = learned(sample)
    assert weights[8] > FIRST[0][8] and weights[2] < FIRST[0][2]
    assert cost[0] >= FIRST[1][0] and learned([]) == FIRST


def test_deep_pages_take_linear_time():
    for piece in ("<div>", "<div>x", "<b>", "<blockquote>x", "<p><span>", "<x-y>", "<td>x</q>"):
        begun = time.process_time()
        blocks(piece * 100_000)
        assert time.process_time() - begun < 5, piece


def test_the_cut_is_least():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randrange(1, 9)
        gain = np.array([rng.choice([-3, -1.5, -0.4, 0.3, 1, 2.5]) for _ in range(n)])
        links = [(i, i + 1, 0.5) for i in range(n - 1)]
        links += [(a, b, rng.random()) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.3]

        def cost(kept):
            own = sum(-g if g < 0 else 0 for g, k in zip(gain, kept) if k)
            own += sum(g if g > 0 else 0 for g, k in zip(gain, kept) if not k)
            return own + sum(w for a, b, w in links if kept[a] != kept[b])

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert cost(minimum_cut(gain, links)) == pytest.approx(best)


def test_pages_of_the_test_tables(spark):
    """Their articles, read by their simple markup."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in extraction.main_texts(pages).collect()}
    for row in pages.collect():
        article = row.html.split("<article>", 1)[1].split("</article>")[0]
        parts = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", article.replace("<br>", "\n")))
        lines = [" ".join(html.unescape(p).split()) for p in parts]
        assert got[row.page_id].text == "\n".join(x for x in lines if x)
        assert got[row.page_id].n_chars == len(got[row.page_id].text)


def test_edge_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "no markup at all"), (3, "w", "<p>" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    extra = pages.selectExpr("*", "1 AS text", "2 AS n_chars")
    got = extraction.main_texts(extra).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert {r.text for r in got if r.page_id in (1, 3, None)} == {""}
    assert extraction.main_texts(pages.limit(0)).count() == 0
