"""Queries over fundamentals and parsed numbers and dates: customers' yearly orders stand for statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, names, numbers
from tidemark.functions.numbers import steady, steady_sql
from tidemark.operators import fundamentals as op
from tidemark.sources.adapters import intraday_bars, read, ticks

from .bars import HOURLY
from .identity import _rows

PERIODS = [str(y) for y in range(1995, 2002)]
AS_OF = "2024-01-30 23:00:00"
NOW = "2026-05-20 10:00:00"


def wide(spark: SparkSession, d: str) -> DataFrame:
    """asset_id, label and a column for each year."""
    years = read(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("string")).groupBy(F.col("o_custkey").alias("asset_id")).pivot("y", PERIODS).agg(F.sum("o_totalprice"))
    lines = [("Total Revenue", 1.0, None), ("Net Income", 0.08, None), ("Cash And Cash Equivalents", 0.1, 2), ("Cash Cash Equivalents And Short Term Investments", 0.12, 3), ("Unknown Line", 0.5, None)]
    label = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(x).alias("share"), F.lit(k).cast("int").alias("gap")) for n, x, k in lines)))
    rows = years.select("*", label.alias("l")).where("l.gap is null or asset_id % l.gap <> 0")
    return rows.select("asset_id", "l.label", *((F.col(f"`{p}`") * F.col("l.share")).alias(p) for p in PERIODS))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return op.unpivoted(wide(spark, d), ["asset_id", "label"], PERIODS)


LINES = """
with y as (select o_custkey as asset_id, cast(year(o_orderdate) as varchar) as period, sum(o_totalprice) as r from orders where year(o_orderdate) between 1995 and 2001 group by 1, 2),
t as (select * from (values ('Total Revenue', 1.0e0, null), ('Net Income', 0.08e0, null), ('Cash And Cash Equivalents', 0.1e0, 2), ('Cash Cash Equivalents And Short Term Investments', 0.12e0, 3), ('Unknown Line', 0.5e0, null)) as t(label, share, gap)),
l as (select asset_id, label, period, r * share as value from y cross join t where gap is null or asset_id % gap <> 0)
"""
PROVIDERS = "select o_custkey as ticker, o_orderkey as priority, case when o_orderkey % 3 <> 0 then o_totalprice end as price, case when o_orderkey % 5 = 0 then o_orderstatus end as status from orders"


def _providers(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(PROVIDERS.replace("from orders", "from {orders}"), orders=read(spark, d, "orders"))


def _document(spark: SparkSession, d: str) -> DataFrame:
    companies = read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Sector"), numbers.plain_number("c_acctbal").alias("Balance"))
    return op.document(companies, op.statements(lines(spark, d)).select("asset_id", "period", "revenue", "net_income", "cash_and_equivalents"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    companies = read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    s = op.statements(lines(spark, d))
    return op.sections(companies, s.select("asset_id", "period", "revenue", "net_income"), s.select("asset_id", "period", (F.col("revenue") / 1e4).alias("eps")))


INFOS = """
select c_custkey as asset_id, chr(123) || '"trailingPE": ' || case when c_custkey % 3 = 0 then '"n/a"' else cast(c_custkey % 50 as varchar) || '.5' end || ', "sharesOutstanding": ' || cast(c_custkey * 1000 as varchar) || ', "beta": "NaN"' || chr(125) as json from customer
"""
NAMES = """
select c_custkey as id, case when c_custkey % 3 = 0 then 'Foo Limited, Bar Inc.' else 'Baz Corp.' end as name, case c_custkey % 4 when 0 then 'HKSE' when 1 then 'NASDAQGS' when 2 then 'LSE main' else 'Madrid' end as market,
  case when c_custkey % 2 = 0 then 'A:B' || cast(c_custkey as varchar) else 'AB' end as pair, 'http://example.com/c/x' || cast(c_custkey as varchar) || case when c_custkey % 5 = 0 then '/' else '' end as url from customer
"""
_infos, _names = _rows(INFOS), _rows(NAMES)

TEXTS = """
select o_orderkey as id, replace(cast(round(o_totalprice, 2) as varchar), '.', ',') || ' €' as french, cast(o_orderkey % 1000 as varchar) || '.5' || case o_orderkey % 5 when 0 then 'B' when 1 then 'M' when 2 then 'T' when 3 then 'K' else '' end as magnitude,
  case o_orderkey % 4 when 0 then 'N/A' when 1 then '-' else cast(o_orderkey % 97 as varchar) || ',25 %' end as share, cast(o_orderkey % 900 as varchar) || ',5 ' || case o_orderkey % 3 when 0 then 'Mrd. EUR' when 1 then 'Mio. EUR' else 'EUR' end as amount,
  case o_orderkey % 7 when 0 then cast(o_orderkey % 20 as varchar) || ' hours ago' when 1 then 'Jan ' || cast(o_orderkey % 28 + 1 as varchar) || ', 2025' when 2 then 'May ' || cast(o_orderkey % 31 + 1 as varchar) when 3 then cast(o_orderkey % 9 as varchar) || ' days ago' when 4 then 'soon' when 5 then '1 week ago' else '5 minutes ago' end as english,
  case o_orderkey % 7 when 0 then 'il y a ' || cast(o_orderkey % 20 as varchar) || 'h' when 1 then lpad(cast(o_orderkey % 28 + 1 as varchar), 2, '0') || '/03/2026' when 2 then cast(o_orderkey % 28 + 1 as varchar) || ' février 2025' when 3 then 'hier' when 4 then 'il y a ' || cast(o_orderkey % 9 as varchar) || ' jours' when 5 then '12 août' else 'bientôt' end as francais
from orders
"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return spark.sql(TEXTS.replace("varchar", "string").replace("from orders", "from {orders}"), orders=o)


_T = f"with t as ({TEXTS.replace('round(o_totalprice, 2)', 'cast(o_totalprice as decimal(18,2))')})"
_MONTH_DAY = "try_cast('2026-05-' || lpad(regexp_extract(english, '^May (\\d+)$', 1), 2, '0') as timestamp)"
QUERIES = {
    "statement_unpivot": (lambda spark, d: lines(spark, d).withColumn("value", steady("value", 2)), LINES + f" select asset_id, label, period, {steady_sql('value', 2)} as value from l"),
    "statement_pivot": (
        lambda spark, d: op.statements(lines(spark, d)).select("asset_id", "period", steady("revenue", 2).alias("revenue"), steady("net_income", 2).alias("net_income"), steady("cash_and_equivalents", 2).alias("cash")),
        LINES + f""" select asset_id, period, {steady_sql("max(case when label = 'Total Revenue' then value end)", 2)} as revenue, {steady_sql("max(case when label = 'Net Income' then value end)", 2)} as net_income,
        {steady_sql("coalesce(max(case when label = 'Cash And Cash Equivalents' then value end), max(case when label like 'Cash Cash%' then value end))", 2)} as cash from l group by 1, 2""",
    ),
    "provider_merge": (
        lambda spark, d: op.merged(_providers(spark, d), "ticker", "priority", ["price", "status"]),
        f"with p as ({PROVIDERS}) select ticker, arg_min(price, priority) filter (where price is not null) as price, arg_min(status, priority) filter (where status is not null) as status from p group by 1",
    ),
    "deep_document": (_document, None),
    "company_sections": (
        lambda spark, d: _sections(spark, d).select("asset_id", F.col("highlights.balance").alias("balance"), F.coalesce(F.size("statements"), F.lit(0)).cast("bigint").alias("n_statements"), F.get("statements", 0)["period"].alias("newest"), steady(F.get("earnings", 0)["eps"], 2).alias("eps")),
        LINES + f""", s as (select asset_id, period, max(case when label = 'Total Revenue' then value end) as r from l group by 1, 2), k as (select asset_id, least(count(*), 5) as n, max(period) as p, arg_max(r, period) as r from s group by 1)
        select c_custkey as asset_id, c_acctbal as balance, coalesce(n, 0) as n_statements, p as newest, {steady_sql("r / 1e4", 2)} as eps from customer left join k on c_custkey = asset_id""",
    ),
    "highlights_json": (
        lambda spark, d: op.highlights(_infos(spark, d)).select("asset_id", "pe_ratio", "shares_outstanding", "beta"),
        f"with i as ({INFOS}) select asset_id, try_cast(json_extract_string(json, '$.trailingPE') as double) as pe_ratio, cast(trunc(try_cast(json_extract_string(json, '$.sharesOutstanding') as double)) as bigint) as shares_outstanding, cast(null as double) as beta from i",
    ),
    "company_names": (
        lambda spark, d: _names(spark, d).select("id", names.plain_company("name").alias("plain"), names.before_comma("name").alias("short"), names.market_name("market").alias("market"), names.swapped("pair", ":").alias("swapped"), names.last_segment("url").alias("tail"), names.between("url", "example.com/", "/x").alias("middle")),
        f"""with n as ({NAMES}) select id, trim(regexp_replace(replace(replace(name, 'Limited', ''), ',', ''), '[.]$', '')) as plain, split_part(name, ', ', 1) as short,
        case id % 4 when 0 then 'Hong Kong Stock Exchange' when 1 then 'NASDAQ' when 2 then 'London' else 'Madrid' end as market, case when id % 2 = 0 then split_part(pair, ':', 2) || ':' || split_part(pair, ':', 1) end as swapped, 'x' || cast(id as varchar) as tail, 'c' as middle from n""",
    ),
    "quote_snapshot": (
        lambda spark, d: op.quotes(intraday_bars(spark, d)).select("asset", *(steady(c).alias(c) for c in ("price", "previous", "change", "change_pct"))),
        f"with b as ({HOURLY}), l as (select asset, max(case when rn = 1 then close end) as p, max(case when rn = 2 then close end) as q from (select *, row_number() over (partition by asset order by ts desc) as rn from b) group by 1) "
        f"select asset, {steady_sql('p')} as price, {steady_sql('q')} as previous, {steady_sql('p - q')} as change, {steady_sql('100 * (p - q) / q')} as change_pct from l",
    ),
    "stale_subscriptions": (
        lambda spark, d: op.stale(ticks(spark, d).select("asset").distinct(), ticks(spark, d), AS_OF, 900),
        f"select event_type as asset, not bool_or(ts > timestamp '{AS_OF}' - interval 900 seconds) as is_stale from events group by 1",
    ),
    "parse_numbers": (
        lambda spark, d: texts(spark, d).select("id", steady(numbers.french_number("french"), 2).alias("french"), steady(numbers.magnitude("magnitude"), 2).alias("magnitude"), steady(numbers.percent_ratio("share")).alias("share"), steady(numbers.currency_amount("amount"), 2).alias("amount"), numbers.plain_number(numbers.first_number("magnitude")).alias("plain")),
        _T + f""" select id, {steady_sql("cast(replace(replace(french, ' €', ''), ',', '.') as double)", 2)} as french,
          {steady_sql("cast(regexp_extract(magnitude, '[0-9.]+') as double) * case right(magnitude, 1) when 'B' then 1e9 when 'M' then 1e6 when 'T' then 1e12 when 'K' then 1e3 else 1 end", 2)} as magnitude,
          {steady_sql("case when share like '%,25 %' then cast(replace(replace(share, ' %', ''), ',', '.') as double) / 100 end")} as share,
          {steady_sql("cast(replace(split_part(amount, ' ', 1), ',', '.') as double) * case when amount like '%Mrd%' then 1e9 when amount like '%Mio%' then 1e6 else 1 end", 2)} as amount, regexp_extract(magnitude, '[0-9]+[.]5') as plain from t""",
    ),
    "parse_dates_en": (
        lambda spark, d: texts(spark, d).select("id", dates.english_date("english", NOW).alias("at")),
        _T + f""", n as (select *, timestamp '{NOW}' as now from t) select id, case when english like '%hours ago' then now - cast(regexp_extract(english, '\\d+') as int) * interval 1 hour when english like '%days ago' then now - cast(regexp_extract(english, '\\d+') as int) * interval 1 day
          when english like '%week ago' then now - interval 7 day when english like '%minutes ago' then now - interval 5 minute when english like 'Jan%' then make_timestamp(2025, 1, cast(regexp_extract(english, '\\d+') as bigint), 0, 0, 0) when english like 'May%' then {_MONTH_DAY} end as at from n""",
    ),
    "parse_dates_fr": (
        lambda spark, d: texts(spark, d).select("id", dates.french_date("francais", NOW).alias("at")),
        _T + f""", n as (select *, timestamp '{NOW}' as now from t) select id, case when francais like 'il y a%h' then now - cast(regexp_extract(francais, '\\d+') as int) * interval 1 hour when francais like 'il y a%jours' then now - cast(regexp_extract(francais, '\\d+') as int) * interval 1 day
          when francais = 'hier' then timestamp '2026-05-19 12:00:00' when francais like '%/03/2026' then make_timestamp(2026, 3, cast(regexp_extract(francais, '\\d+') as bigint), 0, 0, 0) when francais like '%février 2025' then make_timestamp(2025, 2, cast(regexp_extract(francais, '\\d+') as bigint), 0, 0, 0)
          when francais = '12 août' then timestamp '2026-08-12 00:00:00' end as at from n""",
    ),
}
