"""Queries over instruments: customers and suppliers stand for listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.web import SUFFIX, exchange_symbol, market_code, stream_symbol
from tidemark.operators import identity as op
from tidemark.sources.adapters import read, spread

IMPORT = """
select c_custkey as ordinal, case when c_custkey % 23 = 0 then '  ' else ' ' || c_name end as name, case when c_custkey % 19 = 0 then repeat('X', 21) else 't' || cast(c_custkey % 90 as varchar) end as ticker,
  case when c_custkey % 17 = 0 then 'bad' else lower('US' || lpad(cast(c_custkey % 300 as varchar), 10, '0')) end as isin, case when c_custkey % 13 = 0 then 'fund' when c_custkey % 2 = 0 then 'stock' else 'ETF' end as type,
  case when c_custkey % 11 = 0 then 'EU' when c_custkey % 3 = 0 then 'eur' else 'USD' end as currency
from customer
"""
LISTING = """
select c_custkey as listing_id, c_custkey % 400 as asset_id, 'T' || cast(c_custkey % 250 as varchar) as ticker, 'US' || lpad(cast(c_custkey % 400 % 330 as varchar), 9, '0') || '5' as isin,
  case c_custkey % 4 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' else 'CHF' end as currency, case when c_custkey % 3 = 0 then 'import' else 'feed' end as source,
  c_custkey % 5 = 0 as is_primary, c_custkey % 7 <> 0 as active, case c_custkey % 6 when 0 then 'etf' when 1 then 'index' else 'stock' end as type, 'X' || cast(c_nationkey as varchar) as exchange,
  'T' || cast(c_custkey % 3 as varchar) as official_symbol, c_custkey as ordinal, case when c_custkey % 2 = 0 then c_custkey % 10 = 0 end as was_primary
from customer
"""
SYMBOL = """
select c_custkey as id, 'T' || cast(c_custkey % 50 as varchar) || case c_custkey % 6 when 0 then '.PA' when 1 then '.de' when 2 then '.ST' when 3 then '.ZZ' else '' end as ticker,
  case c_custkey % 4 when 0 then 'PAR' when 1 then 'xetra' when 2 then 'NYQ' else 'none' end as exchange from customer
"""


def _rows(sql: str, given=read):
    return lambda spark, d: spark.sql(sql.replace("varchar", "string").replace("from customer", "from {customer}"), customer=given(spark, d, "customer"))


def _pages(sql: str):
    """Rows that Python reads one by one, on all cores."""
    return _rows(sql, lambda spark, d, name: spread(read(spark, d, name)))


imports, listings, symbols = _rows(IMPORT), _rows(LISTING), _rows(SYMBOL)
ERRORS = "list_filter([case when name = '' then 'name' end, case when length(ticker) not between 1 and 20 then 'ticker' end, case when not regexp_full_match(isin, '[A-Z]{2}[A-Z0-9]{10}') then 'isin' end, case when type not in ('STOCK', 'ETF') then 'type' end, case when not regexp_full_match(currency, '[A-Z]{3}') then 'currency' end], lambda x: x is not null)"
_KIND = "case when type = 'stock' then 0 when type = 'etf' then 1 else 2 end"
_ORDER = f"{_KIND}, currency <> 'USD', source <> 'import', not is_primary, ticker, currency, exchange"


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).select("asset_id", "isin").distinct()


def _repair(spark: SparkSession, d: str, which: int) -> DataFrame:
    rows = listings(spark, d)
    return op.repaired(_assets(spark, d), rows.select("listing_id", "asset_id", "ticker", "exchange", "currency"), ["asset_id", "ticker", "exchange", "currency"])[which]


def _requests(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("request_id"), F.when(k % 3 == 0, F.concat(F.lit("US"), F.lpad((k % 330).cast("string"), 9, "0"), F.lit("5"))).alias("isin"), F.concat(F.lit("T"), (k % 300).cast("string")).alias("ticker"), F.concat(F.lit("X"), F.col("s_nationkey").cast("string")).alias("exchange"))


_A = f"with l as ({LISTING}), a as (select distinct asset_id, isin from l), k as (select asset_id, min(asset_id) over (partition by isin) as canonical from a)"
QUERIES = {
    "csv_validate": (
        lambda spark, d: op.checked_import(imports(spark, d)).select("ordinal", "name", "ticker", "isin", "type", "currency", F.array_join("errors", ",").alias("errors"), "is_duplicate"),
        f"""with i as ({IMPORT}), c as (select ordinal, trim(name) as name, upper(trim(ticker)) as ticker, upper(trim(isin)) as isin, upper(trim(type)) as type, upper(trim(currency)) as currency from i), e as (select *, {ERRORS} as errors from c)
        select ordinal, name, ticker, isin, type, currency, array_to_string(errors, ',') as errors, len(errors) = 0 and row_number() over (partition by isin, currency, len(errors) = 0 order by ordinal) > 1 as is_duplicate from e""",
    ),
    "primary_flag": (
        lambda spark, d: op.primary_flags(listings(spark, d)).select("listing_id", "is_primary"),
        f"""with l as ({LISTING}), w as (select *, bool_or(coalesce(was_primary, false)) over (partition by isin) as any_primary, count(was_primary) over (partition by isin) > 0 as old, row_number() over (partition by isin order by ordinal) = 1 as first,
          min(case when was_primary is null and currency in ('USD', 'GBP', 'JPY', 'CHF', 'CAD', 'AUD') then ordinal end) over (partition by isin) as c from l)
        select listing_id, case when was_primary is not null then was_primary when any_primary then false when old then coalesce(ordinal = c, false) else first end as is_primary from w""",
    ),
    "listing_identity": (lambda spark, d: op.by_identity(listings(spark, d)).select("ticker", "listing_id"), f"with l as ({LISTING}) select ticker, listing_id from l qualify row_number() over (partition by ticker order by {_ORDER}, listing_id) = 1"),
    "preferred_listing": (
        lambda spark, d: op.preferred(listings(spark, d)).select("asset_id", "listing_id"),
        f"""with l as ({LISTING}), u as (select *, bool_or(active) over (partition by asset_id) as a, ticker = official_symbol as o from l) select asset_id, listing_id from u where active or not a
        qualify row_number() over (partition by asset_id order by case when o then 0 when is_primary then 1 else 2 end, case when o then currency <> 'USD' end nulls first, case when o then source <> 'import' end nulls first, case when o then not is_primary end nulls first, ticker, currency, exchange, listing_id) = 1""",
    ),
    "dup_diagnose": (
        lambda spark, d: op.duplicate_groups(_assets(spark, d)).select("isin", "canonical", F.array_join("ids", ",").alias("ids"), "n"),
        _A + " select isin, min(asset_id) as canonical, array_to_string(list_sort(list(asset_id)), ',') as ids, count(*) as n from a group by 1 having count(*) > 1",
    ),
    "dup_repair_assets": (lambda spark, d: _repair(spark, d, 0), _A + " select a.* from a join k using (asset_id) where asset_id = canonical"),
    "dup_repair_listings": (
        lambda spark, d: _repair(spark, d, 1),
        _A + " select listing_id, canonical as asset_id, ticker, exchange, currency from l join k using (asset_id) qualify row_number() over (partition by canonical, ticker, exchange, currency order by listing_id) = 1",
    ),
    "asset_resolve": (
        lambda spark, d: op.resolved(_requests(spark, d), listings(spark, d)).select("request_id", "asset_id", "way"),
        f"""with l as ({LISTING}), r as (select s_suppkey as request_id, case when s_suppkey % 3 = 0 then 'US' || lpad(cast(s_suppkey % 330 as varchar), 9, '0') || '5' end as isin, 'T' || cast(s_suppkey % 300 as varchar) as ticker, 'X' || cast(s_nationkey as varchar) as exchange from supplier),
        f as (select request_id, 1 as way, l.* from r join l on r.isin = l.isin union all select request_id, 2, l.* from r join l on r.ticker = l.ticker and r.exchange = l.exchange union all select request_id, 3, l.* from r join l on r.ticker = l.ticker),
        b as (select request_id, asset_id, way from f qualify row_number() over (partition by request_id order by way, {_ORDER}, listing_id) = 1) select request_id, asset_id, way from r left join b using (request_id)""",
    ),
    "symbol_translate": (
        lambda spark, d: symbols(spark, d).select("id", market_code("ticker").alias("mic"), stream_symbol("ticker")["exchange"].alias("stream_exchange"), stream_symbol("ticker")["symbol"].alias("stream_symbol"), exchange_symbol("ticker", "exchange").alias("symbol")),
        f"""with s as ({SYMBOL}), u as (select id, upper(ticker) as t, upper(exchange) as x from s)
        select id, case when t like '%.PA' then 'XPAR' when t like '%.DE' then 'XETR' when t like '%.ST' then 'XSTO' end as mic, case when t like '%.PA' then 'EURONEXT' when t like '%.DE' then 'XETRA' when t like '%.ST' then 'OMX' else 'NASDAQ' end as stream_exchange,
          case when t like '%.ZZ' then t else split_part(t, '.', 1) end as stream_symbol, case when t like '%.%' then t when x = 'PAR' then t || '{SUFFIX["PAR"]}' when x = 'XETRA' then t || '{SUFFIX["XETRA"]}' when x = 'NYQ' then t end as symbol from u""",
    ),
}
