"""Queries over news pages: each given page stands for the news page of one provider, with the faults that pages have (tags left open, single quotes, entities, cards without links)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import cards as op
from tidemark.sources.adapters import read, spread
from tidemark.sources.pages import feed_articles

NOW = "2024-06-01 12:00:00"
PROVIDERS = ["zonebourse", "boursorama", "investing", "marketwatch", "msn"]
#: <k> stands for the page's number, <d> for its last digit.
HTML = {
    "zonebourse": "<ul class='a liste-actus'><li><h4 class=t>News &amp; <k></h4><a href=/z/<k>>more</a><span class=\"x-date\">1<d>/05/2024</span><li><a href='/none'>abc</a><li><span>no link</span><li><a href=http://z/<k>>Second &lt;<k>&gt;</a><span class='Source'>il y a <d> h</span></ul>",
    "boursorama": "<div class=\"c-list-info-item u\"><a class=c-link href=https://b/<k>>Titre &eacute;t&eacute; <k></a><p class=\"c-intro\">Sum <k></p><time datetime='bad'>1<d> mai 2024</time><div class=c-source>AFP</div></div><article class=c-article-item><a href=/no>Not in the first kind of card</a></article>",
    "investing": "<article class=\"news-item\"><img data-src=http://i/<k>.png><a title=t href=\"/e/<k>\"><b>Head <i>line</i> <k></b></a><time datetime='2024-01-1<d>T10:00:00+02:00'></article><article class=news-item><a>No address at all</a></article>",
    "marketwatch": "<div class=article__content><h3 class=article__Headline><a href='/m/<k>'>Story of <k></a></h3><span class=\"article__timestamp\" data-est=\"2024-02-1<d>T01:02:03\">x</span><span class=article__author>By A<d></span></div>",
    "msn": "<DIV data-t=story><a href=/s/<k>><h2>no</h2><span class=x-Title>Money <k></span></a><time datetime=\"2024-03-1<d>\">",
}
SUBCARDS = '{"subCards":[{"title":"Feed <k>","url":"http://f/<k>","publishedDateTime":"2024-04-01T00:00:00Z","thumbnail":{"resolutions":[{"url":"http://t/<k>"},{"url":"no"}]}},{"title":"no address"}]}'
_K, _D = "cast(page_id as varchar)", "cast(page_id % 10 as varchar)"


def _made(text: str) -> str:
    return "'" + text.replace("'", "' || chr(39) || '").replace("<k>", f"' || {_K} || '").replace("<d>", f"' || {_D} || '") + "'"


def _of(texts: list[str]) -> str:
    return f"case page_id % {len(texts)} {' '.join(f'when {i} then {t}' for i, t in enumerate(texts))} end"


PAGE = {"key": "page_id", "provider": _of([f"'{p}'" for p in PROVIDERS]), "html": f"case when page_id % 31 = 0 then null when page_id % 29 = 0 then '<p>nothing' else {_of([_made(HTML[p]) for p in PROVIDERS])} end"}
MSN = {"key": "page_id", "provider": "'msn'", "html": f"case when page_id % 7 <> 0 then {_made(HTML['msn'])} end"}
FEED = {"key": "page_id", "json": f"case when page_id % 4 = 0 then {_made(SUBCARDS)} else '{{}}' end"}


def _rows(columns: dict[str, str]):
    return lambda spark, d: spread(read(spark, d, "pages").select("page_id")).selectExpr(*(f"{what.replace('varchar', 'string')} as {name}" for name, what in columns.items()))


pages, msn, feed = map(_rows, (PAGE, MSN, FEED))


def _with_fallback(spark: SparkSession, d: str) -> DataFrame:
    articles = feed_articles(feed(spark, d), "msn", ["key"]).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    return op.with_fallback(articles, op.news_cards(msn(spark, d), NOW))


QUERIES = {
    "news_cards": (
        lambda spark, d: op.news_cards(pages(spark, d), NOW),
        f"""with p as (select page_id, page_id % 5 as n, {_K} as k, {_D} as d, page_id % 10 as x from pages where page_id % 31 <> 0 and page_id % 29 <> 0),
        c as (
          select page_id as key, n, 0 as place, case n when 0 then 'News & ' || k when 1 then 'Titre été ' || k when 2 then 'Headline' || k when 3 then 'Story of ' || k else 'Money ' || k end as title,
            case n when 0 then 'https://www.zonebourse.com/z/' when 1 then 'https://b/' when 2 then 'https://www.investing.com/e/' when 3 then 'https://www.marketwatch.com/m/' else 'https://www.msn.com/s/' end || k as url,
            case when n = 1 then 'Sum ' || k end as summary, case when n = 3 then 'By A' || d end as author, case n when 0 then 'ZoneBourse' when 1 then 'AFP' when 2 then 'Investing.com' when 3 then 'MarketWatch' else 'MSN Finance' end as source,
            case when n = 2 then 'http://i/' || k || '.png' end as image,
            case when n <= 1 then make_timestamp(2024, 5, 10 + x, 0, 0, 0) when n = 2 then make_timestamp(2024, 1, 10 + x, 8, 0, 0) when n = 3 then make_timestamp(2024, 2, 10 + x, 1, 2, 3) else make_timestamp(2024, 3, 10 + x, 0, 0, 0) end as published_at from p
          union all select page_id, n, 3, 'Second <' || k || '>', 'http://z/' || k, null, null, 'il y a ' || d || ' h', null, timestamp '{NOW}' - x * interval 1 hour from p where n = 0)
        select key, case n when 0 then 'zonebourse' when 1 then 'boursorama' when 2 then 'investing' when 3 then 'marketwatch' else 'msn' end as provider, place, title, url, summary, author, source, image, published_at, case when n <= 1 then 'fr' else 'en' end as language from c""",
    ),
    "news_fallback": (
        _with_fallback,
        f"""select page_id as key, 'Feed ' || {_K} as title, 'http://f/' || {_K} as url, cast(null as varchar) as source, timestamp '2024-04-01 00:00:00' as published_at, 'en' as language, 'msn' as provider, 'http://t/' || {_K} as image from pages where page_id % 4 = 0
        union all select page_id, 'Money ' || {_K}, 'https://www.msn.com/s/' || {_K}, 'MSN Finance', make_timestamp(2024, 3, 10 + page_id % 10, 0, 0, 0), 'en', 'msn', null from pages where page_id % 4 <> 0 and page_id % 7 <> 0""",
    ),
}
