"""Queries over symbol searches, provider pages and end-of-day records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numbers import steady, steady_sql
from tidemark.operators import search as op
from tidemark.sources import pages
from tidemark.sources.adapters import brand_bars, read

from .bars import BRAND
from .identity import _pages, _rows

HITS = """
select c_nationkey as request_id, 'q' || cast(c_nationkey as varchar) as query, case when c_custkey % 9 = 0 then 'Q' || cast(c_nationkey as varchar) else 'X:S' || cast(c_custkey as varchar) end as symbol,
  case c_custkey % 4 when 0 then 'EQUITY' when 1 then 'ETF' when 2 then 'stock' else 'OTHER' end as kind, case when c_custkey % 5 <> 0 then c_custkey % 3 <> 0 end as own, cast(c_custkey % 101 as double) as score,
  case when c_custkey % 2 = 0 then 'us' else 'FR' end as country, case when c_custkey % 6 = 0 then 'XPAR' when c_custkey % 6 = 1 then 'XNYS' else 'XLON' end as market, 'I' || cast(c_custkey as varchar) as isin,
  case when c_custkey % 3 = 0 then c_acctbal end as price, case when c_custkey % 7 <> 0 then 'EUR' end as currency
from customer
"""
TERMS = """
select c_custkey as id, 'T' || cast(c_custkey as varchar) as ticker, 'US' || lpad(cast(c_custkey as varchar), 10, '0') as isin, case when c_custkey % 5 = 0 then 'D' || cast(c_custkey as varchar) end as default_ticker,
  case when c_custkey % 7 = 0 then 'http://x/' || cast(c_custkey as varchar) end as mapped_url, case when c_custkey % 3 = 0 then 'M' || cast(c_custkey as varchar) when c_custkey % 3 = 1 then '' end as mapped_ticker,
  case when c_custkey % 2 = 0 then 'O' || cast(c_custkey as varchar) end as official_symbol, case when c_custkey % 4 = 0 then 'PAR' when c_custkey % 4 = 1 then 'NYQ' else 'none' end as exchange from customer
"""
PAGES = """
select c_custkey as key, case c_custkey % 4 when 0 then 'zonebourse' when 1 then 'googlefinance' when 2 then 'marketwatch' else 'nobody' end as provider,
  '<table><tr><th>' || case c_custkey % 4 when 0 then 'Chiffre d''affaires' else 'Revenue' end || '</th><td>' || case c_custkey % 4 when 0 then cast(c_custkey as varchar) || ' 000,5 €' else cast(c_custkey as varchar) || '.5M' end || '</td></tr><tr><td>P/E Ratio</td><td>'
  || cast(c_custkey % 40 as varchar) || '.25</td></tr><tr><td>P/E</td><td>99</td></tr></table><dl><dt>Dividend Yield:</dt><dd>' || case when c_custkey % 3 = 0 then '-' else '2.5' end || '</dd></dl>' as html from customer
"""
PLACED = HITS.replace("select ", "select c_custkey as place, ", 1)
hits, placed, terms, provider_pages = _rows(HITS), _rows(PLACED), _rows(TERMS), _pages(PAGES)
_NOT = "coalesce({}, true)"


def _best(order, columns: str, sql: str, given=hits, place=None):
    return lambda spark, d: op.best(given(spark, d), order(), place).select("request_id", "symbol", "isin"), f"with h as ({HITS}) select request_id, symbol, isin from h qualify row_number() over (partition by request_id order by {sql}) = 1"


EXCHANGES = "select n_nationkey as place, 'Bourse of ' || n_name as name, r_name as country, '.' || substr(n_name, 1, 2) as suffix from nation join region on n_regionkey = r_regionkey"
ASKED = "select c_custkey as id, case c_custkey % 7 when 0 then lower(c_mktsegment) when 1 then 'an' || substr('ada', 1, cast(c_custkey % 3 as int)) when 2 then 'ASIA' when 3 then 'bourse' when 4 then '' when 5 then null else 'of m' end as name from customer"
FETCHES = "select o_custkey as company, o_orderkey as place, case when o_orderkey % 11 <> 0 then cast(o_orderdate as varchar) end as filed, case when o_orderkey % 13 <> 0 then 'a' || cast(o_orderkey as varchar) end as accession, case when o_orderkey % 29 <> 0 then o_orderkey * 7 % 10 > 5 end as ok, case when o_orderkey % 17 <> 0 then o_orderkey % 4 end as n from orders"


def _sql(spark, d, sql: str, *tables: str):
    for t in tables:
        sql = sql.replace(f" {t} ", f" {{{t}}} ") if f" {t} " in sql else sql.replace(f" {t}", f" {{{t}}}")
    return spark.sql(sql.replace("varchar", "string"), **{t: read(spark, d, t) for t in tables})


QUERIES = {
    "exchange_by_part": (
        lambda spark, d: op.exchange_by_part(_sql(spark, d, ASKED, "customer"), _sql(spark, d, EXCHANGES, "nation", "region")).select("id", "name", "suffix"),
        f"with a as ({ASKED}), e as ({EXCHANGES}) select id, a.name, (select arg_min(suffix, place) from e where contains(upper(e.name), upper(a.name)) or contains(upper(e.country), upper(a.name))) as suffix from a",
    ),
    "form4_fetches": (
        lambda spark, d: pages.kept_fetches(_sql(spark, d, FETCHES, "orders"), 6).select("company", "place", "ok", "n", "before"),
        f"""with f as ({FETCHES}), l as (select *, row_number() over (partition by company order by place) as nth from f qualify nth <= 12),
        t as (select company, place, coalesce(ok, false) as ok, case when ok then coalesce(n, 0) else 0 end as n from l where filed is not null and accession is not null),
        s as (select *, coalesce(sum(n) over (partition by company order by place rows between unbounded preceding and 1 preceding), 0) as before,
          not ok and not coalesce(lag(ok, 1) over w, true) and not coalesce(lag(ok, 2) over w, true) as third from t window w as (partition by company order by place)),
        e as (select *, coalesce(bool_or(third) over (partition by company order by place rows between unbounded preceding and 1 preceding), false) as over_ from s)
        select company, place, ok, n, cast(before as bigint) as before from e where not over_ and before < 6""",
    ),
    "search_quote": _best(op.quote_order, "", "not coalesce(own, true), upper(symbol) <> upper(query), kind not in ('EQUITY', 'ETF'), score desc, symbol", placed, "place"),
    "search_symbol": _best(op.symbol_order, "", "split_part(upper(symbol), ':', -1) <> upper(query), upper(country) <> 'US', kind <> 'stock', score desc, symbol"),
    "search_item": _best(op.item_order, "", "upper(symbol) <> upper(query), price is null, currency is null, symbol, isin"),
    "search_market": _best(op.market_order, "", "upper(symbol) <> upper(query), case market when 'XPAR' then 1 when 'XNYS' then 7 else 8 end, upper(symbol), market, isin"),
    "search_term": (
        lambda spark, d: op.search_term(terms(spark, d)).select("id", "term", "how"),
        f"""with t as ({TERMS}), m as (select *, coalesce(official_symbol, ticker) || case exchange when 'PAR' then '.PA' when 'NYQ' then '' end as made from t)
        select id, coalesce(mapped_url, nullif(mapped_ticker, ''), default_ticker, made, ticker) as term, case when mapped_url is not null then 'url' when nullif(mapped_ticker, '') is not null then 'mapped' when default_ticker is not null then 'default' when made is not null then 'made' else 'ticker' end as how from m""",
    ),
    "page_metrics": (
        lambda spark, d: pages.page_metrics(provider_pages(spark, d)).select("key", steady("revenue", 2).alias("revenue"), steady("pe_ratio", 2).alias("pe_ratio"), steady("dividend_yield", 2).alias("dividend_yield")),
        f"""with p as ({PAGES}) select key, {steady_sql("case key % 4 when 0 then key * 1000 + 0.5e0 when 1 then (key + 0.5e0) * 1e6 end", 2)} as revenue, {steady_sql("case when key % 4 < 3 then key % 40 + 0.25e0 end", 2)} as pe_ratio,
        {steady_sql("case when key % 4 < 3 and key % 3 <> 0 then 2.5e0 end", 2)} as dividend_yield from p""",
    ),
    "eod_records": (
        lambda spark, d: op.eod_records(brand_bars(spark, d).where(F.col("ts").between(*op.period_bounds("1y", "1999-12-31"))).withColumn("adj_close", F.lit(None).cast("double"))).select("asset", "date", steady("close").alias("close"), steady("adj_close").alias("adj_close"), "volume"),
        f"with b as ({BRAND}) select asset, strftime(ts, '%m-%d-%Y') as date, {steady_sql('close')} as close, {steady_sql('close')} as adj_close, volume from b where ts between date '1998-12-31' and date '1999-12-31'",
    ),
}
