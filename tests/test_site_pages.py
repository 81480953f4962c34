"""Selectors, and candidates of three platforms' pages."""

import time
from datetime import date

import pytest

from linkweave.operators import site_pages
from linkweave.sources import markup

PAGE = """<html><body><h1 id=top class="a b">One &amp; two</h1><div class="box" data-k="x-price-1"><p>first<p>second <b>bold</b></p><ul><li><a href="/s/1?x">L1</a><li>L2</ul></div>
<div class=box><span>s</span><br><img src=i><p>third</p></b></div></body></html>"""


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("h1", ["One & two"]), ("#top.a", ["One & two"]), (".box p", ["first", "second bold", "third"]), (".box > p:nth-of-type(2)", ["second bold"]), ("div.box:nth-child(3) p", ["third"]), ("[data-k*='price'] li", ["L1", "L2"]),
        ("[data-k^=x] a, h1", ["One & two", "L1"]), ("a[href$='x']", ["L1"]), ("[href]", ["L1"]), ("body > p", []), ("div:first-child", []), ("p b", ["bold"]), ("* span", ["s"]),
    ],
)
def test_selectors(selector, texts):
    tree = markup.Tree(PAGE)
    assert [tree.text_of(k) for k in markup.select(tree, selector)] == texts


@pytest.mark.parametrize("selector", ["", "a >", "a,,b", "a:hover", "a ! b"])
def test_unreadable_selectors(selector):
    with pytest.raises(ValueError, match="unreadable selector"):
        markup.compiled(selector)


def test_deep_and_unbalanced_pages_take_linear_time():
    start = time.time()
    for html in ("<div>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<p>" * 50_000):
        markup.select(markup.Tree(html), "div div > div.a, p p")
    assert time.time() - start < 15


HIP = """<h1> X-Men (1991-2001) </h1><a href="/price-guide/comic/x-men-1991/3/">x</a><div class="r-detail-attribute"><span class="r-detail-attribute__label">Issue</span><span>#3</span><span>#3</span></div>
<div class="r-detail-attribute"><b class="r-detail-attribute__label">Publisher</b><i>Marvel</i></div><p class="cover-date">March 1, 1992</p><p class="variant">News-stand b</p><p class="price">$3.50</p><p class="page-count">36 pages</p><p class="upc">759606045</p>"""
AA = """<h2 class="dropLeftMargin"><a href="/atomic/series/16287">Leave it to Chance Leave it to Chance</a></h2><span id="ctl00_ContentPlaceHolder1_lblIssueName"><a>Leave it to  Chance #5B</a> of many</span>
<div class="dropLeftMargin">Image, 1996-1999</div><div class="dropLeftMargin">nothing</div>"""
LOCG = """<title>X-Men #-1 | League of Comic Geeks</title><h1 class="page-title">X-Men #1</h1><a href="/comics/dark-horse/z">dark horse</a> /comic/111275/ (1991 – 2001) (1991–2001) variant: B <span class="variant-x">Deluxe</span>
released July 4, 1997 $1.95 <span class="upc">759606045</span><b>UPC</b> 759606045012"""


def test_pages_to_candidates(spark):
    rows = [
        (1, "hip", HIP), (2, "aa", AA), (3, "locg", LOCG), (4, "hip", "<h1>X</h1>"), (5, "aa", "<h2 class=dropLeftMargin>T</h2><p class=issueSearchIssueNum>1 - 3</p>"), (6, "locg", "<h1>Only</h1>"), (7, "aa", None), (8, "gcd", "<p>"), (9, None, "<p>"),
        (10, "hip", "<h1>(1990)</h1><p class='x-issue-number-y'>1-1</p><div class=r-detail-attribute><b class=r-detail-attribute__label>Series</b><b>Saga (2012)</b></div>"), (11, "aa", "<h2 class=dropLeftMargin>T</h2><p class=issueSearchIssueNum>#1-3</p>"),
        (12, "locg", "<title>A Reviews</title><h2 class=\"the-issue\">No #1/2</h2>Published 1980 by Marvel Comics 2001-13-45 Dec 5 2001"), (13, "hip", ""),
    ]
    found = {r.page_id: r for r in site_pages.page_candidates(spark.createDataFrame(rows, "page_id long, platform string, html string")).collect()}
    assert len(found) == len(rows)
    assert tuple(found[1])[2:] == ("X-Men", "x-men-1991", 1991, "Marvel", "3", "NEWSSTANDB", "News-stand b", date(1992, 3, 1), 3.5, 36, "759606045", None)
    assert tuple(found[2])[2:] == ("Leave it to Chance", "16287", 1996, "Image", "5", "B", None, None, None, None, None, None)
    assert tuple(found[3])[2:] == ("X-Men #-1", "111275", 1991, "Dark Horse", "1", "B", "Deluxe", date(1997, 7, 4), 1.95, None, "759606045012", None)
    assert {k: found[k].error for k in (4, 5, 6, 7, 8, 9, 11, 13)} == {4: "no_number", 5: "no_number", 6: "no_number", 7: "empty_page", 8: "unknown_site", 9: "unknown_site", 11: "MULTI_ISSUE_RANGE", 13: "empty_page"}
    assert (found[10].series_title, found[10].start_year, found[10].number) == ("Saga", 2012, "-1")
    assert found[12].error is None
    assert (found[12].series_title, found[12].number, found[12].publisher, found[12].start_year, found[12].cover_date) == ("A", "1/2", "Marvel Comics", 1980, date(2001, 12, 5))
    assert site_pages.page_candidates(spark.createDataFrame([], "page_id long, platform string, html string")).count() == 0


def test_references_without_a_semicolon_may_be_kept(spark):
    html = '<title>a &amp;&amp; b &lt;c&gt; &amp</title><a href="/x?a&amp=1&amp;b">l</a><script>a && b &amp</script>'
    read = lambda closed: {k: v[0]["value"] for k, v in markup.read_fields(spark.createDataFrame([(1, "s", html)], "page_id int, platform string, html string"), [("s", "t", "title", "text"), ("s", "h", "a", "@href"), ("s", "j", "script", "text")], closed=closed).first()["fields"].items()}
    assert read(False)["t"] == "a && b <c> &"
    assert read(True) == {"t": "a && b <c> &amp", "h": "/x?a&amp=1&b", "j": "a && b &amp"}


def test_pages_are_read_without_a_join(spark):
    pages = spark.createDataFrame([(1, "hip", HIP)], "page_id long, platform string, html string")
    assert "Join" not in site_pages.page_candidates(pages)._jdf.queryExecution().executedPlan().toString()
