"""Articles from the news pages of providers: rules for each provider say which elements are cards and where a card has its parts.

A null page, one of a provider without rules and one without cards have no articles. A card without a link, or whose title has fewer than five characters, is none.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions.pagetree import Element, marked, select, tree

LEAST_TITLE = 5


class Part(NamedTuple):
    """An element of one of the tags (any if there are none) with one of the words in a class (any class if there are none)."""

    tags: tuple[str, ...] = ()
    words: tuple[str, ...] = ()


class Cards(NamedTuple):
    places: tuple[str, ...]  # selectors of cards, of which the first that finds some counts
    site: str  # what an address that begins with / is added to
    language: str
    source: str  # where a card names none
    title: tuple[Part, ...]  # of several parts the first that a card has counts, here and below; without any it is the link's text
    time: tuple[Part, ...]
    stamps: tuple[str, ...] = ("datetime",)  # attributes of the element of the time
    words: bool = False  # whether a date in words counts too
    sources: tuple[Part, ...] = ()
    authors: tuple[Part, ...] = ()
    summaries: tuple[Part, ...] = ()
    images: tuple[str, ...] = ()  # attributes of a card's first picture


_HEADS = Part(("h2", "h3", "h4"))
_TIME = Part(("time",))
#: Provider: its cards. Selectors, words, addresses and names are fixed values.
CARDS = {
    "zonebourse": Cards(
        ("ul.liste-actus li", "div.actu-item", "article.news-item", "div.article-item", "li.list-news-item"), "https://www.zonebourse.com", "fr", "ZoneBourse",
        title=(_HEADS,), time=(Part(("time", "span"), ("date", "time", "publi")), Part(("span",), ("source",))), words=True, sources=(Part((), ("source", "provider")),),
    ),
    "boursorama": Cards(
        ("div.c-list-info-item", "article.c-article-item", "div.l-list-news__item", "li.news-item", "div.u-news-item"), "https://www.boursorama.com", "fr", "Boursorama",
        title=(Part((), ("title", "headline", "link")), _HEADS), time=(_TIME,), words=True, sources=(Part((), ("source", "provider", "author")),), summaries=(Part((), ("summary", "excerpt", "intro")),),
    ),
    "investing": Cards(
        ("div.articleItem", "article.news-item", 'div[data-test="news-item"]', "li.js-article-item"), "https://www.investing.com", "en", "Investing.com",
        title=(Part((), ("title", "headline")),), time=(_TIME,), sources=(Part((), ("source", "publisher", "provider", "details")),), images=("src", "data-src"),
    ),
    "marketwatch": Cards(
        ("div.article__content", "article.article--story", "div.collection__elements article", 'div[data-layout="article"]'), "https://www.marketwatch.com", "en", "MarketWatch",
        title=(Part((), ("headline", "title")), Part(("h3", "h4"))), time=(_TIME, Part((), ("timestamp", "pubdate"))), stamps=("datetime", "data-est"), authors=(Part((), ("author", "byline")),),
    ),
    "msn": Cards(('div.newsitem, article, div[data-t="story"]',), "https://www.msn.com", "en", "MSN Finance", title=(Part(("h3", "h4", "span"), ("title", "headline")),), time=(_TIME,)),
}
FIELDS = ["title", "url", "summary", "author", "source", "image", "stamp", "said"]


def _first(card: Element, parts: tuple[Part, ...]) -> Element | None:
    return next((x for p in parts if (x := marked(card, *p)) is not None), None)


def _attribute(x: Element | None, names: tuple[str, ...]) -> str | None:
    return next((v for n in names if (v := x.attributes.get(n))), None) if x is not None else None


def _article(card: Element, rules: Cards) -> dict | None:
    link = next(select(card, "a[href]"), None)
    if link is None:
        return None
    url = link.attributes["href"]
    said = lambda parts: None if (x := _first(card, parts)) is None else x.text()
    title = said(rules.title)
    title = link.text() if title is None else title
    if len(title) < LEAST_TITLE:
        return None
    at = _first(card, rules.time)
    source = said(rules.sources)
    values = (title, rules.site + url if url.startswith("/") else url, said(rules.summaries), said(rules.authors), rules.source if source is None else source, _attribute(marked(card, ("img",), ()), rules.images), _attribute(at, rules.stamps), at.text() if at is not None and rules.words else None)
    return dict(zip(FIELDS, values, strict=True))


def articles_of(page: str | None, provider: str | None, most: int) -> list[dict]:
    """place (from 0) and FIELDS of the articles among the first ``most`` cards of a page."""
    rules = CARDS.get((provider or "").lower())
    if rules is None or not page:
        return []
    root = tree(page)
    cards = next((found for way in rules.places if (found := list(select(root, way)))), [])
    made = ((i, _article(card, rules)) for i, card in enumerate(cards[:most]))
    return [{"place": i, **a} for i, a in made if a is not None]


def news_cards(pages: DataFrame, now: str, most: int = 20) -> DataFrame:
    """key, provider, place, title, url, summary, author, source, image, published_at, language of the articles of ``pages`` (key, provider, html).

    The first ``most`` cards of a page are looked at, as a request has that limit. An article's time is that of an ISO stamp; on French pages it may be
    a date in words too, in the stamp or else in the text, told from ``now`` on.
    """

    def run(html: pd.Series, provider: pd.Series) -> pd.Series:
        return pd.Series([articles_of(page, name, most) for page, name in zip(html, provider, strict=True)], dtype=object)

    kind = "array<struct<place:int," + ",".join(f"{f}:string" for f in FIELDS) + ">>"
    each = pages.select("key", "provider", F.explode(F.pandas_udf(run, kind)("html", "provider")).alias("a"))
    language = F.create_map(*(F.lit(x) for name, c in CARDS.items() for x in (name, c.language)))[F.lower("provider")]
    iso = F.when(F.col("a.stamp").rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp("a.stamp").cast("timestamp_ntz"))
    at = F.coalesce(iso, F.when(language == "fr", F.coalesce(dates.french_date("a.stamp", now), dates.french_date("a.said", now))))
    return each.select("key", "provider", *(f"a.{f}" for f in ("place", *FIELDS[:-2])), at.alias("published_at"), language.alias("language"))


def with_fallback(feed: DataFrame, cards: DataFrame) -> DataFrame:
    """key and an article's columns: those of ``feed``, and those of ``cards`` of keys for which the feed has none."""
    columns = ["key", "title", "url", "source", "published_at", "language", "provider", "image"]
    return feed.select(columns).unionByName(cards.join(feed.select("key").distinct(), "key", "left_anti").select(columns))
