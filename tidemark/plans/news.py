"""Queries over news and pages: documents stand for articles, their whole first lines for titles, and a day (of a ticker) for a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import web
from tidemark.operators import news as op
from tidemark.sources.adapters import read

ARTICLES = """
select doc_id as ordinal, split_part(coalesce(text, ''), chr(10), 1) as title, 'https://news.example.com/' || cast(doc_id as varchar) as url, source as provider, lang as language,
  case when doc_id % 50 <> 0 then timestamp '2024-01-01 00:00:00' + cast(doc_id * 37 % 40000 as int) * interval 1 minute end as published_at, 'T' || cast(doc_id % 20 as varchar) as t1, 'T' || cast(doc_id % 7 as varchar) as t2
from documents
"""


def articles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    number = lambda n: F.concat(F.lit("T"), (k % n).cast("string"))
    return read(spark, d, "documents").select(
        k.alias("ordinal"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"), F.concat(F.lit("https://news.example.com/"), k.cast("string")).alias("url"),
        F.col("source").alias("provider"), F.col("lang").alias("language"), F.when(k % 50 != 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 37 % 40000 as int))")).alias("published_at"), F.array(number(20), number(7)).alias("tickers"),
    )


_TRACKING = ", ".join(f"'{t}'" for t in web.TRACKING)
CANONICAL = f"""
with p as (select page_id, lower(url) as u from pages), f as (select page_id, split_part(u, '#', 1) as u from p),
s as (select page_id, regexp_replace(regexp_replace(split_part(u, '?', 1), ';[^/]*$', ''), '/+$', '') as base, case when u like '%?%' then substr(u, strpos(u, '?') + 1) else '' end as q from f),
k as (select page_id, base, list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]+=.') and not list_contains([{_TRACKING}], split_part(x, '=', 1))) as kept from s),
c as (select page_id, base || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url from k)
"""

QUERIES = {
    "url_canonical": (lambda spark, d: read(spark, d, "pages").select("page_id", web.canonical_url("url").alias("url")), CANONICAL + " select * from c"),
    "news_url_dedup": (
        lambda spark, d: op.exact_dedup(read(spark, d, "pages").select(F.col("page_id").alias("ordinal"), "url")),
        CANONICAL + " select c.page_id as ordinal, pages.url from c join pages using (page_id) qualify row_number() over (partition by c.url order by c.page_id) = 1",
    ),
    "news_title_dedup": (lambda spark, d: op.title_dedup(articles(spark, d).withColumn("day", F.to_date("published_at")), ["day"]).select("ordinal", "title", "provider", "day"), None),
    "ticker_news": (lambda spark, d: op.ticker_news(articles(spark, d).withColumns({"day": F.to_date("published_at"), "ticker": F.explode(F.array_distinct("tickers"))}), ["ticker", "day"], "en", 10).select("ticker", "day", "ordinal", "title", "provider", "published_at"), None),
    "news_in_language": (
        lambda spark, d: articles(spark, d).withColumn("language", F.when(F.col("ordinal") % 9 != 0, F.col("language"))).where(op.in_language("en")).select("ordinal", "language"),
        f"with a as (select ordinal, case when ordinal % 9 <> 0 then language end as language from ({ARTICLES})) select ordinal, language from a where language is null or language = 'en'",
    ),
    "news_feed": (
        lambda spark, d: op.feed(articles(spark, d), "en", ["T1", "T2"], 40).select("ordinal", "url", "published_at"),
        f"with a as ({ARTICLES}) select ordinal, url, published_at from a where language = 'en' and (t1 in ('T1', 'T2') or t2 in ('T1', 'T2')) order by published_at desc nulls first, url limit 40",
    ),
    "news_stats": (
        lambda spark, d: op.counts(articles(spark, d)),
        f"with a as ({ARTICLES}) select 'provider' as kind, provider as name, count(*) as n, max(published_at) as latest from a group by 2 union all select 'language', language, count(*), max(published_at) from a group by 2",
    ),
    "news_top_tickers": (
        lambda spark, d: op.top_tickers(articles(spark, d)),
        f"with a as ({ARTICLES}), t as (select t1 as ticker from a union all select t2 from a where t1 <> t2) select ticker, count(*) as n from t group by 1 order by n desc, ticker limit 10",
    ),
}
