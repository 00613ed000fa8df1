"""Pages read by one expression, against the standard parser."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest

from tidemark.functions import markup, pagetree, web
from tidemark.plans import connectors
from tidemark.sources import connectors as fields

BITS = [
    "<", ">", "/", "p", "Div", "td", " ", "\n", "\t", "\x0b", "\xa0", "=", '"', "'", "a", "class", "data-x", "&amp;", "&", ";", "&#39", "&eacute", "x", "1", "<p>", "</p>", "<td class='a b'>", '<a href="u">', "<br/>", "<br />", "<!--", "-->", "<script>", "</script>", "<title>", "</title>",
    "é", "`", "\0", "<b a=1 b>", "</td >", "]]>", "<![CDATA[", "<?x", "<h1 id=q/>", "İ", "K", "ſ", "<TITLE/>", "<a b=c/d>", "<a\x0bb>", "</ p>", "<p=>", "<a b='>'>", "<a b=\n", "<a b =c>", "<a b='' C>", "<img a=b=c>", "<li>", "<ul>", "</ul>", "<tr>", "<table>", "EPS: 1", "<dd>", "<dt>",
]


class Calls(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("start", tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.seen.append(("both", tag, attrs))

    def handle_endtag(self, tag):
        self.seen.append(("end", tag))

    def handle_data(self, data):
        self.seen.append(("data", data))


def random_pages(n: int):
    r = random.Random(5)
    for _ in range(n):
        yield "".join(r.choice(BITS) for _ in range(r.randint(0, 9)))


def test_a_page_makes_the_calls_of_the_standard_parser():
    for page in [*random_pages(60_000), "<p " + " " * 50_000 + "<", "<p" + " a" * 5_000 + "<p>", '<p a="' * 200, "<a b=" + "c" * 50_000, "</p" + " " * 50_000]:
        want, got = Calls(), Calls()
        want.feed(page)
        want.close()
        markup.read(got, page)
        assert got.seen == want.seen, page[:200]


def test_plain_pages_are_not_fed_to_the_slow_parser(monkeypatch):
    def fed(self, page):
        raise AssertionError(page)

    monkeypatch.setattr(HTMLParser, "feed", fed)
    assert web.labels_of("<table><tr><th>A:</th><td> 1 &amp; 2</td></tr></table><dl><dt>b<dd class='x y'>3</dl>") == [{"label": "A", "value": "1 & 2"}, {"label": "b", "value": "3"}]
    for html in connectors.HTML.values():
        if "<!--" not in html:
            assert next(pagetree.tree(html.replace("<k>", "7").replace("<d>", "7").replace("<i>", "00000007")).inside()).tag
    with pytest.raises(AssertionError):
        pagetree.tree("<!-- a -->")


def test_short_texts_are_read_once_for_several_rules(monkeypatch):
    read, whole = [], pagetree.Element._text

    def counted(x, most):
        read.append(most)
        return whole(x, most)

    monkeypatch.setattr(pagetree.Element, "_text", counted)
    page = "<h1>x</h1>" + "<li>no label here</li>" * 100 + "<li>EPS: 1.5</li>"
    assert pagetree.picked(pagetree.tree(page), fields.RULES["marketwatch"]) == [{"field": "name", "text": "x"}, {"field": "eps", "text": "1.5"}]
    assert len(read) == 102  # three rules look at 101 elements


def test_elements_are_chosen_as_by_a_walk():
    def walk(x):
        for y in x.children:
            if isinstance(y, pagetree.Element):
                yield y
                yield from walk(y)

    for page in random_pages(3_000):
        root = pagetree.tree(page)
        every = list(walk(root))
        assert list(root.inside()) == every
        for selector, wanted in [("td, p", lambda x: x.tag in ("td", "p")), (".a, div", lambda x: x.tag == "div" or "a" in x.attributes.get("class", "").split()), ("*", lambda x: True), ("td.a[class]", lambda x: x.tag == "td" and "a" in x.attributes.get("class", "").split())]:
            assert list(pagetree.select(root, selector)) == [x for x in every if wanted(x)]
