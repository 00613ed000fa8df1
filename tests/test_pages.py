"""Page trees and connectors on odd pages."""

from __future__ import annotations

import time

import pytest

from tidemark.functions.pagetree import Rule, picked, select, table_rows, tree
from tidemark.sources import connectors


@pytest.mark.parametrize(
    "page,selector,texts",
    [
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "li", ["a", "bc", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><th>3<td><table><tr><td>in</table>4</table>", "tr", ["12", "3in4", "in"]),
        ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "dd", ["b", "d"]),
        ("<p>a<p>b<div>c</div><p>d", "p", ["a", "b", "d"]),
        ("<div class='x y'><b>1</b></div><div class=y><b>2</b></div>", ".x b, div.y > b".replace(" >", ""), ["1", "2"]),
        ("<a href=u>1</a><a href='v'>2</a><a>3</a>", 'a[href="v"]', ["2"]),
        ("<a href=u>1</a><a>3</a>", "a[href]", ["1"]),
        ("<h1>&eacute;t&eacute; &lt;b&gt; &#8364;</h1><script><h1>no</h1></script>", "h1", ["été <b> €"]),
        ("<h1> a <b> c </b> d", "h1", ["acd"]),
        ("</p></div><i>x</i></b>", "i", ["x"]),
        ("<img src=x><br/><span id=s>y</span>", "#s", ["y"]),
        ("", "p", []),
        ("text only &amp; < b", "p", []),
        ("<!-- <p>no</p> --><![CDATA[<p>]]><p>yes", "p", ["yes"]),
        ("<div " + "a=1 " * 1000 + ">x", "div", ["x"]),
    ],
)
def test_elements(page, selector, texts):
    assert [x.text() for x in select(tree(page), selector)] == texts


def test_next_is_the_next_element():
    root = tree("<ul><li>a</li> text <li>b</li><!-- c --></ul><p>d")
    assert [(x.text(), n.text() if (n := x.next()) else None) for x in select(root, "li")] == [("a", "b"), ("b", None)]


def test_rules():
    one = lambda page, *rule: [x["text"] for x in picked(tree(page), [Rule("f", *rule)])]
    assert one("<li>Sector: A: B<li>x", "after colon", "li", ("Sector",)) == ["A"]
    assert one("<li>A: Sector", "after colon", "li", ("Sector",)) == []
    assert one(f"<li>Sector: {'a' * 100}", "after colon", "li", ("Sector",)) == []
    assert one("<td>EPS: 1.5 or 2.5<td>9", "near", "td", ("eps",)) == ["2.5"]
    assert one("<td>EPS<td>none</td><td>EPS</td><td>7.25 (8)", "near", "td", ("EPS",)) == ["7.25"]
    assert one("<div><p>Yield<p>n/a<p>3</div><div><p>yield</p><p>4.5</div>", "pair", "div", ("Yield",)) == ["4.5"]
    assert one("<dl><dt>EPS<dd>1<dt>EPS<dd>2<dt>EPS<dd>-</dl><dt>EPS<p>3", "term", "", ("EPS",)) == ["2"]
    assert one("<h1></h1><h1>b", "text", "h1") == ["b"]
    assert picked(tree("<table><tr><td>A x<td>1<td>2<tr><th>b<td>3<tr><td><td>4<tr></table>"), [Rule("", "rows", "table tr", (("a", "fa"), ("x", "fx"), ("b", "fb")))]) == [{"field": "fa", "text": "1\n2"}, {"field": "fb", "text": "3"}]
    assert table_rows(tree("<table class=t><tbody><tr><td>1<td>2<tr><td>3</table>"), "table.t", 2) == [["1", "2"]] and table_rows(tree("<p>"), "table", 1) == []


def test_a_bad_page_costs_no_other(spark):
    rows = [(1, "barrons", None), (2, "nobody", "<p>"), (3, "BARRONS", "<h1>Ok</h1>"), (4, "barrons", ""), (5, "barrons", "<p>x"), (6, None, "<h1>a</h1>"), (7, "investing", "<dl><dt>EPS<dd>1"), (8, "boursedirect", "<p class=quotation-last>1 234,5</p>"), (8, "boursedirect", "<p class=quotation-last>x</p>")]
    got = [(r.key, r.status, r.error, r.name, r.price) for r in connectors.provider_fields(spark.createDataFrame(rows, "key int, provider string, html string")).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "error", "ValueError: no page", None, None), (2, "error", "ValueError: no rules", None, None), (3, "ok", None, "Ok", None), (4, "error", "ValueError: no element", None, None), (5, "no_data", None, None, None), (6, "error", "ValueError: no rules", None, None), (7, "ok", None, None, None), (8, "ok", None, None, 1234.5), (8, "no_data", None, None, None)],
        key=str,
    )
    assert connectors.provider_fields(spark.createDataFrame([], "key int, provider string, html string")).count() == 0


def test_a_million_characters_take_seconds():
    began = time.perf_counter()
    for page in ("<div>" * 2000, "<li>Yield " * 100_000, "<p>" * 200_000 + "EPS: 1", "<b>x</b>" * 100_000, "a" * 1_000_000):
        picked(tree(page), connectors.RULES["wallstreetjournal"])
    assert time.perf_counter() - began < 40


def test_cards_on_odd_pages():
    from tidemark.sources.cards import articles_of

    assert [articles_of(p, n, 20) for p, n in ((None, "msn"), ("", "msn"), ("<article><a href=/x>A title", "nobody"), ("<p>none", "MSN"), ("<article><a href=/x>A title", None))] == [[]] * 5
    page = "<article><a href=/1>First one<article><a>no address</a><span class=Headline>Inner title</span><a href=http://x/2 class=q>z</a></article><article><a href=/3>four</a><article><a href=''>Empty address"
    assert [(a["place"], a["title"], a["url"]) for a in articles_of(page, "msn", 20)] == [(0, "Inner title", "https://www.msn.com/1"), (1, "Inner title", "http://x/2"), (3, "Empty address", "")]
    many = "".join(f"<div class='articleItem'><a href=/{i}>Title {i}</a><img src='' data-src=/p{i}></div>" for i in range(30))
    assert [(a["url"][-2:], a["image"]) for a in articles_of(many, "investing", 3)] == [(f"/{i}", f"/p{i}") for i in range(3)]
    long = "<ul class=liste-actus>" + "<li><a href=/n>A long title</a>" + "<b>" * 20000 + "</ul>"
    began = time.perf_counter()
    assert articles_of(long, "zonebourse", 20)[0]["title"] == "A long title" and time.perf_counter() - began < 20


def test_dates_in_words_only_count_on_french_pages(spark):
    import datetime as dt

    from tidemark.sources.cards import news_cards

    card = "<div class='{}'><a href=/x class=title>Some title</a><time datetime='{}'>{}</time></div>"
    cases = [
        ("boursorama", "c-list-info-item", "2024-05-01T10:00:00Z", "hier", dt.datetime(2024, 5, 1, 10)), ("boursorama", "c-list-info-item", "", "il y a 3h", dt.datetime(2024, 6, 1, 9)), ("boursorama", "c-list-info-item", "x", "hier", dt.datetime(2024, 5, 31, 12)),
        ("boursorama", "c-list-info-item", "2024-13-45", "", None), ("investing", "articleItem", "16/05/2024", "hier", None), ("investing", "articleItem", "2024-05-01", "", dt.datetime(2024, 5, 1)),
    ]
    pages = spark.createDataFrame([(i, p, card.format(c, stamp, said)) for i, (p, c, stamp, said, _) in enumerate(cases)], "key long, provider string, html string")
    assert {r.key: r.published_at for r in news_cards(pages, "2024-06-01 12:00:00").collect()} == {i: c[-1] for i, c in enumerate(cases)}
    assert news_cards(pages.limit(0), "2024-06-01 12:00:00").count() == 0


def test_images_of_feeds(spark):
    from tidemark.sources.pages import feed_articles

    item = '{{"items":[{{"title":"t","url":"u"{}}}]}}'
    cases = [("", None), (',"imageUrl":"a","image":"b"', "a"), (',"image":{"url":"c"}', "c"), (',"imageUrl":"","thumbnail":{"imageUrl":"d"}', "d"), (',"thumbnail":{"resolutions":[{"url":"e"},{"url":"f"}]}', "e"), (',"image":{}', None), (',"image":["x"]', None), (',"image":null,"thumbnail":"g"', "g")]
    made = spark.createDataFrame([(i, item.format(x)) for i, (x, _) in enumerate(cases)], "key int, json string")
    assert {r.key: r.image for r in feed_articles(made, "p", ["key"]).collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_import_adds_nothing_twice(spark):
    from tidemark.operators.imports import default_mappings, new_listings

    known = spark.createDataFrame([("I1", "A.PA", "XPAR", "EUR", False), ("I2", "B", "", None, None)], "isin string, ticker string, exchange string, currency string, is_primary boolean")
    rows = spark.createDataFrame([(1, "I1", "A.PA", "EUR"), (2, "I1", "A", "EUR"), (3, "I1", "A", "USD"), (4, "I2", "B", None), (5, "I3", "C.ST", None), (6, "I3", "C.ST", None), (7, "I3", "C.L", "GBP")], "ordinal long, isin string, ticker string, currency string")
    new = new_listings(known, rows)
    assert sorted((r.ordinal, r.ticker, r.exchange, r.is_primary) for r in new.collect()) == [(2, "A", "", False), (3, "A", "", True), (5, "C.ST", "XSTO", True), (7, "C.L", "XLON", False)]
    none = spark.createDataFrame([], "isin string, ticker string, exchange string, currency string, provider_name string")
    made = default_mappings(new, none)
    assert sorted((r.isin, r.ticker, r.provider_name, r.provider_url.rsplit("/", 1)[1]) for r in made.collect()) == [
        ("I1", "A", "YahooFinance", "A"), ("I3", "C.L", "GoogleFinance", "C:LON"), ("I3", "C.L", "YahooFinance", "C.L"), ("I3", "C.ST", "GoogleFinance", "C:STO"), ("I3", "C.ST", "YahooFinance", "C.ST"),
    ]
    assert default_mappings(new, made).count() == 0 and new_listings(known.unionByName(new.select(known.columns)), rows).count() == 0
