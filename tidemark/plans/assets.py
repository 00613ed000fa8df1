"""Queries over assets: customers and orders stand for assets, mappings and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import steady, steady_sql
from tidemark.operators import assets as op
from tidemark.operators import quality
from tidemark.sources.adapters import intraday_bars, read

from .bars import HOURLY
from .identity import _rows
from .quality import H, _health

MAPPINGS = """
select c_custkey as mapping_id, c_custkey % 300 as asset_id, case when c_custkey % 3 = 0 then c_custkey end as listing_id, 'p' || cast(c_custkey % 4 as varchar) as provider, 'v' || cast(c_custkey as varchar) as value, c_custkey % 7 <> 0 as is_active from customer
"""
TERMS = """
select c_custkey as asset_id, array_of('t' || cast(c_custkey as varchar), ' T' || cast(c_custkey as varchar), 'US' || lpad(cast(c_custkey as varchar), 10, '0'), case when c_custkey % 2 = 0 then '' else 'x' || cast(c_custkey % 5 as varchar) end, 'y.PA') as terms from customer
"""
PAIRS = """
select c_custkey as id, 'T' || cast(c_custkey as varchar) || case when c_custkey % 3 = 0 then '.PA' else '' end as ticker, case c_custkey % 4 when 0 then 'XPAR' when 1 then 'XLON' else 'none' end as exchange, case when c_custkey % 5 = 0 then '' else 'I' || cast(c_custkey % 4 as varchar) end as isin_a,
  case when c_custkey % 7 = 0 then null else 'I' || cast(c_custkey % 6 as varchar) end as isin_b, case when c_custkey % 2 = 0 then 'STOCK' else 'etf' end as kind_a, case when c_custkey % 3 = 0 then 'stock' end as kind_b, case when c_custkey % 2 = 0 then 'zonebourse' else 'barrons' end as provider from customer
"""
mappings, pairs = _rows(MAPPINGS), _rows(PAIRS)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return _rows(TERMS.replace("array_of", "array"))(spark, d)


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return mappings(spark, d).select("asset_id").distinct()


def _listings(spark: SparkSession, d: str) -> DataFrame:
    return mappings(spark, d).where("listing_id is not null").select("asset_id", "listing_id", F.col("value").alias("ticker"), F.col("provider").alias("exchange"), F.lit("EUR").alias("currency"))


def _ingest(spark: SparkSession, d: str, which: int) -> DataFrame:
    bars = intraday_bars(spark, d, "day")
    stored = bars.where("ts < timestamp_ntz'2024-01-20' and asset < 'q' or ts >= timestamp_ntz'2024-01-29' and asset > 'r'")
    fetched = bars.withColumns({"ordinal": F.lit(1), "close": F.col("close") + 1})
    return op.ingest(stored, fetched.where("asset < 'q'"), fetched.withColumn("open", F.col("open") + 1), "2024-01-30")[which]


M = f"with m as ({MAPPINGS}), f as (select * from m where is_active qualify row_number() over (partition by asset_id, provider order by (listing_id is not null) desc, mapping_id desc) = 1)"
_DAY = HOURLY.replace("'hour'", "'day'")
INGEST = f"""with b as ({_DAY}), st as (select * from b where ts < timestamp '2024-01-20' and asset < 'q' or ts >= timestamp '2024-01-29' and asset > 'r'),
r as (select a.asset, max(st.ts) as last from (select distinct asset from b) a left join st using (asset) group by 1),
n as (select b.asset, b.ts, case when b.asset < 'q' then open else open + 1 end as o, high, low, close + 1 as c, volume from b join r using (asset) where (last is null or last < timestamp '2024-01-29' and b.ts > last) and b.ts <= timestamp '2024-01-30'),
nn as (select asset, ts, o as open, greatest(o, high, low, c) as high, least(o, high, low, c) as low, c as close, volume from n)"""
QUERIES = {
    "mappings_in_force": (lambda spark, d: op.mappings_in_force(mappings(spark, d)).select("asset_id", "provider", "value"), M + " select asset_id, provider, value from f"),
    "asset_context": (
        lambda spark, d: op.context(_assets(spark, d), _listings(spark, d), mappings(spark, d)).select("asset_id", F.coalesce(F.size("listings"), F.lit(0)).cast("bigint").alias("n_listings"), F.array_join(F.transform("listings", lambda x: x["ticker"]), ",").alias("tickers"), F.array_join(F.transform(F.array_sort(F.map_entries("mappings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("mappings")),
        M + """, l as (select asset_id, count(*) as n, string_agg(value, ',' order by listing_id) as t from m where listing_id is not null group by 1), g as (select asset_id, string_agg(provider || '=' || value, ',' order by provider) as s from f group by 1)
        select asset_id, coalesce(n, 0) as n_listings, t as tickers, s as mappings from (select distinct asset_id from m) left join l using (asset_id) left join g using (asset_id)""",
    ),
    "enrichment_candidates": (
        lambda spark, d: op.candidates(_terms(spark, d)).select("asset_id", F.col("place").cast("bigint").alias("place"), "term"),
        f"""with t as ({TERMS.replace("array_of", "list_value")}), e as (select asset_id, generate_subscripts(terms, 1) as p, upper(trim(unnest(terms))) as term from t), u as (select asset_id, term, min(p) as p from e where term <> '' and not regexp_full_match(term, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') group by 1, 2)
        select asset_id, row_number() over (partition by asset_id order by p) as place, term from u""",
    ),
    "metadata_compatible": (
        lambda spark, d: pairs(spark, d).select("id", op.compatible(F.col("isin_a"), F.col("isin_b"), F.col("kind_a"), F.col("kind_b")).alias("fits"), op.quote_address(F.col("ticker"), F.col("exchange")).alias("address"), op.compatible_provider(F.col("provider"), F.col("ticker"), ["zonebourse"]).alias("provider_fits")),
        f"""with p as ({PAIRS}) select id, (isin_a = '' or isin_b is null or isin_a = isin_b) and not coalesce(lower(kind_a) <> lower(kind_b), false) as fits,
        'https://www.google.com/finance/quote/' || split_part(ticker, '.', 1) || ':' || case exchange when 'XPAR' then 'EPA' when 'XLON' then 'LON' end as address, provider <> 'zonebourse' or ticker like '%.PA' as provider_fits from p""",
    ),
    "latest_statement": (
        lambda spark, d: op.latest_by(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus"),
        "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    ),
    "provider_rates": (
        lambda spark, d: op.with_open_alerts(op.rolling_rates(_health(spark, d), "2024-01-30"), quality.alert_history(_health(spark, d)).where("type = 'canary_failed'")).select("provider", steady("rate").alias("rate"), steady("rate_30d").alias("rate_30d"), "open_alerts"),
        H + f""", c2 as (select provider, max(case when passed then date end) as last_ok, max(case when not passed then date end) as last_bad from h group by 1)
        select provider, {steady_sql("avg(success_rate) filter (where date > date '2024-01-30' - 7)")} as rate, {steady_sql("avg(success_rate)")} as rate_30d, max(case when last_bad > coalesce(last_ok, date '1900-01-01') then 1 else 0 end)::bigint as open_alerts
        from h join c2 using (provider) where date between date '2024-01-30' - 29 and date '2024-01-30' group by 1""",
    ),
    "highlights_fallback": (
        lambda spark, d: op.highlights_with_fallback(
            read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).otherwise(0.0).alias("pe")).where("asset_id % 5 <> 0"),
            read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit(7.5)).alias("pe")), ["pe"]),
        "select c_custkey as asset_id, coalesce(case when c_custkey % 5 <> 0 and c_custkey % 3 <> 0 then nullif(c_acctbal, 0) end, case when c_custkey % 2 = 0 then 7.5e0 end) as pe from customer",
    ),
    "ingest_bars": (lambda spark, d: _ingest(spark, d, 0), INGEST + " select * from nn union all select st.* from st anti join nn on st.asset = nn.asset and st.ts = nn.ts"),
    "ingest_log": (
        lambda spark, d: _ingest(spark, d, 1),
        INGEST + ", g as (select asset, count(*) as n from nn group by 1) select asset, case when last >= timestamp '2024-01-29' then 'up_to_date' when n > 0 then 'success' else 'failed' end as status, coalesce(n, 0) as n from r left join g using (asset)",
    ),
}
