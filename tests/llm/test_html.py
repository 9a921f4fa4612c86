import html as unescape
import re

import pyarrow.parquet as pq
import pytest

from lumenframe.llm import html as H

COST = {"p": 0.3, "/p": 0.3, "h1": 0.3, "/h1": 0.3, "div": 3.0, "/div": 3.0, "article": float("inf"), "/article": float("inf"), "a": 3.0, "/a": 3.0, "li": 3.0, "/li": 3.0}


def test_all_pages_against_their_article(spark):
    from lumenframe.llm.queries import op2

    pages = {r["page_id"]: r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()}
    rows = op2(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        want = " ".join(unescape.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize("page,want", [
    ("<nav><a>Home</a> one two three</nav><article><h1>Title</h1><p>Some <b>bo</b>ld text.</p></article><footer>Foot</footer>", "Title Some bold text."),
    ("<body><div class='sidebar'>many words that are not it at all</div><div><p>The text of the page &amp; more&hellip;</p></div><form>Mail: <input></form></body>", "The text of the page & more…"),
    ("<article><p>First part of it.</p><aside>Related things</aside><p>Second part.</p><div id=comments><p>I disagree with all of this.</p></div></article>", "First part of it. Second part."),
    ("<script>var x='<p>no</p>';</script><style>p{}</style><p>Only  this\n\ttext</p><noscript>none</noscript>", "Only this text"),
    ("<div class='cookie-notice'>We use cookies</div><main><p>Words of the page</p></main>", "Words of the page"),
    ("<article><p>cut off at the en", "cut off at the en"), ("plain words", "plain words"), ("", ""), ("<p></p><br>", ""), ("<!-- c --><p>a&#233;b<!-- x -->c</p>", "aébc"),
])
def test_pages(page, want):
    assert H.extract_text(page, COST) == want


FIVE = "".join(f"<p>Paragraph number {i} has a few ordinary words in it.</p>" for i in range(5))
TEXT = " ".join(f"Paragraph number {i} has a few ordinary words in it." for i in range(5))
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a>About us</a></li></ul></nav>"
MENU = "<div><ul>" + "".join(f"<li><a href=/{k}>Link to {k} page</a></li>" for k in range(12)) + "</ul></div>"


@pytest.mark.parametrize("first,last", [
    ("<div class='post comments-open'>", "</div>"), ("<div class='layout has-sidebar'>", "</div>"), ("<div id='page-social'>", "</div>"), ("<article><section class='product reviews'>", "</section></article>"), ("<form action=/x>", "</form>"),
    ("<form><div class=content>", "</div></form>"), ("<div class=search><form>", "</form></div>"),
])
@pytest.mark.parametrize("cost", [{}, COST])
def test_names_are_evidence_and_no_verdict(first, last, cost):
    assert H.extract_text(f"<html><body>{NAV}{first}{FIVE}{last}<footer>Foot notes here now</footer></body></html>", cost) == TEXT


@pytest.mark.parametrize("page,want", [
    ("<article><h1>T</h1><p class='notice'>Notice<p>First paragraph of words here.<p>Second paragraph of words here.</article>", "T First paragraph of words here. Second paragraph of words here."),
    ("<body><ul><li class='nav'>x<li>first real item of text here<li>second real item of text</ul><p>And a paragraph.</p></body>", "first real item of text here second real item of text And a paragraph."),
    ("<table><tr><td class=ad>Buy it<td>The first cell holds some text<tr><td>and so does the second one</table>", "The first cell holds some text and so does the second one"),
    (f"<main><h1>Head</h1><article>{FIVE}</article><p>Outro of the page is here.</p></main>", f"Head {TEXT} Outro of the page is here."),
    (f"<article>{FIVE}</article><div class=ad>Buy this thing right now please</div><article><p>The second article has words also.</p></article>", f"{TEXT} The second article has words also."),
    (f"<article>{FIVE}</article><p>Words between the two, no part of either.</p><article><p>The second.</p></article>", f"{TEXT} The second."),
    (f"<article>{FIVE}<div id=comments><p>I disagree with all of this and more, so very much more than the text.</p></div></article>", TEXT),
    ("<article><h1>T</h1><p>Short news item of ten words.</p><div id=comments><p>" + "I disagree " * 60 + "</p></div></article>", "T Short news item of ten words."),
    (f"<article>{FIVE}<section class='comment-list'><article class=comment><p>A comment in an article of its own.</p></article></section></article>", TEXT),
    (f"<header><p>Site of the day, a header</p></header><article><header><h1>Title</h1></header>{FIVE}<footer>Filed by someone</footer></article>", f"Title {TEXT}"),
    (f"<nav><ul><li>never closed<article>{FIVE}</article>", TEXT),
    (f"<article>{FIVE}<h2>See</h2><ul><li><a>One</a></li><li><a>Two</a></li></ul></article>", f"{TEXT} See One Two"),
])
@pytest.mark.parametrize("cost", [{}, COST])
def test_blocks_and_omitted_end_tags(page, want, cost):
    assert H.extract_text(page, cost) == want


def test_trained_costs_beat_flat_ones(spark):
    """Pages without names and content elements: what the labelled pages taught about tags finds the text."""
    labelled = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    cost = H.train(labelled)
    assert cost["li"] > 3 * cost["p"] and cost == {k: v for k, v in cost.items() if H.LEAST <= v <= H.WALL}
    page = f"<body>{MENU}<div>{FIVE}</div>{MENU}</body>"
    assert H.extract_text(page, cost) == TEXT and "Link to" in H.extract_text(page, {})


def test_region_is_the_best_of_all_by_brute_force():
    page = H.Page("<li>a</li><li>b c</li><p>one two three</p><p>four five</p><div>x</div><li>y z</li>")
    value, _ = H.scored(page, COST)
    best = max((sum(value[i:j]), -i, -(j - i)) for i in range(len(value)) for j in range(i + 1, len(value) + 1))
    start, end = H.best_region(value)
    assert sum(value[start:end]) == pytest.approx(best[0])


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, 3), (1, "u", "<p>a b c</p>" * 20000, 4), (None, "v", "<p>x</p>", 5)], "page_id long, url string, html string, text int")
    rows = H.extract(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 1, 119999] and rows[0].text == ""
    assert H.extract(df.limit(0)).count() == 0
