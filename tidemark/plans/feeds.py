"""Queries over fetched documents: pages, filings, feeds and messages are written from rows of customers, and SQL knows what they hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions import dates, names, numbers, web
from tidemark.functions.numbers import steady, steady_sql
from tidemark.operators import assets, document, fundamentals, identity, imports, logs, quality, search
from tidemark.session import scratch_path
from tidemark.sources import pages, profiles
from tidemark.sources.adapters import brand_bars, read, tick_stream
from tidemark.sources.adapters import ticks as ticks_of
from tidemark.streaming import ticks

from .bars import BRAND
from .identity import LISTING, _pages, _rows, listings

_OPEN, _SHUT = "' || chr(123) || '", "' || chr(125) || '"


def _json(text: str) -> str:
    """SQL for a JSON text; ``<k>`` stands for c_custkey, braces are written by their codes."""
    return "'" + text.replace("{", _OPEN).replace("}", _SHUT).replace("<k>", "' || cast(c_custkey as varchar) || '") + "'"


TEXTS = """
select c_custkey as id, cast(c_custkey % 12 + 1 as varchar) || '/' || cast(c_custkey % 28 + 1 as varchar) || '/2024' as us, cast(c_custkey % 31 as varchar) || ' of ' || cast(c_custkey as varchar) || '.5 shares [note ' || cast(c_custkey as varchar) || ']' as noted,
  case c_custkey % 4 when 0 then 'N/A' when 1 then '1 ' || cast(c_custkey as varchar) || ',9 %' else cast(c_custkey as varchar) end as whole, case when c_custkey % 3 = 0 then 'A' else '' end || cast(c_custkey as varchar) as code, 'Été No ' || cast(c_custkey as varchar) || ' -- Ça' as title,
  'see US' || lpad(cast(c_custkey as varchar), 10, '0') || ' or /FR0000120271/' as isins, 'a' || cast(c_custkey as varchar) || '=1;b=' || cast(c_custkey % 7 as varchar) as pairs, c_custkey * 1000 as seconds, c_custkey % 5 as buy, c_custkey % 3 as hold, case when c_custkey % 6 <> 0 then c_custkey % 4 end as sell
from customer
"""
PAGE = """
select c_custkey as key, '<table class="wikitable"><tr><th>' || case c_custkey % 2 when 0 then 'Symbol' else 'Ticker' end || '</th><th>Company</th><th>Sector</th></tr><tr><td>t' || cast(c_custkey as varchar) || '[1]</td><td> Firm  ' || cast(c_custkey as varchar) || '</td><td>S' || cast(c_custkey % 9 as varchar)
  || '</td></tr><tr><td></td><td></td><td></td></tr></table><dl><dt>Beta:</dt><dd>' || cast(c_custkey % 7 as varchar) || '.5</dd></dl><a href="/n/' || cast(c_custkey as varchar) || '"><b>News</b> of ' || cast(c_custkey as varchar) || '</a><time datetime="2024-01-0' || cast(c_custkey % 9 + 1 as varchar) || '">x</time><a href="">No address here</a><a href="/s">abc</a>' as html
from customer
"""
FORM = f"""
select c_custkey as key, '<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Owner ' || cast(c_custkey as varchar) || '</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-02-0' || cast(c_custkey % 9 + 1 as varchar)
  || '</value></transactionDate><transactionCoding><transactionCode>' || case c_custkey % 3 when 0 then 'P' when 1 then 'S' else 'Q' end || '</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>' || cast(c_custkey as varchar) || '</value></transactionShares><transactionPricePerShare><value>'
  || case when c_custkey % 4 = 0 then 'none' else '2.5' end || '</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>' || case when c_custkey % 10 = 0 then '<broken' else '' end as xml,
  '~m~9~m~hello~m~99~m~' || {_json('{"m":"timescale_update","p":["s",{"sds_1":{"s":[{"v":[<k>,1.5,3,1,2,10]},{"v":[<k>,2,null,1,2,10]},{"v":[7]}]}}]}')} as message,
  {_json('{"filings":{"recent":{"form":["4","10-K","4"],"filingDate":["2024-01-02","2024-01-05","2024-03-01"],"accessionNumber":["a<k>","b<k>","c<k>"]}}}')} as filings,
  {_json('[{"data":[{"figi":"F<k>","ticker":"T<k>","exchCode":"US"}]},{"error":"No identifier found."}]')} as mapped,
  {_json('{"value":[{"headline":"News <k>","link":"http://n/<k>","source":"S","datePublished":"2024-01-02T03:04:05Z","image":{"url":"http://i/<k>","w":1}},{"title":"","url":"http://none"}],"other":1}')} as feed,
  {_json('{"ter":"0,20 %","fundSize":"<k>,5 Mio. EUR","currency":"EUR","holdings":[{"name":"H<k>","percentage":"12,5 %"}]}')} as fund
from customer
"""
PROFILE = "select c_custkey as asset_id, case when c_custkey % 2 = 0 then c_mktsegment when c_custkey % 3 = 0 then '' end as sector, case when c_custkey % 5 = 0 then c_name end as name from customer"
ALERTS = "select c_custkey as alert_id, case when c_custkey % 4 = 0 then timestamp '2024-01-05 00:00:00' end as resolved_at from customer"
texts, profile, alerts = map(_rows, (TEXTS, PROFILE, ALERTS))
page, form = map(_pages, (PAGE, FORM))


def _written_bars(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark)
    search.write_bars(brand_bars(spark, d), path)
    return spark.read.parquet(path).where("month between '1996-03' and '1996-08'").groupBy("asset", F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").cast("bigint").alias("volume"))


def _written_records(spark: SparkSession, d: str, kind: str) -> DataFrame:
    path = scratch_path(spark)
    rows = read(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    search.write_records(rows, path, kind)
    back = spark.read.schema("c_custkey long, c_name string, segment string")
    return back.option("header", True).csv(path) if kind == "csv" else back.json(path)


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("asset_id"), F.year("o_orderdate").alias("period")).agg(F.max("o_totalprice").alias("x"))
    return assets.estimates(o.where("period % 2 = 0").select("asset_id", "period", (F.col("x") / 1e4).alias("eps")), o.where("period > 1995").select("asset_id", "period", F.col("x").alias("revenue")))


PROVIDERS = ["Zonebourse", "Google", "Barrons"]
ASKED = "select c_custkey as request_id, 'T' || cast(c_custkey % 40 as varchar) || case c_custkey % 3 when 0 then '.PA' when 1 then '.ST' else '' end as ticker, case c_custkey % 4 when 0 then ' google ,nobody' when 1 then '' else 'ZONEBOURSE' end as names, c_custkey % 700 as days, case when c_custkey % 2 = 0 then 'Foo Limited, Inc.' else 'Société A.B.' end as company from customer"
WRAPPED = f"select 'Q' || cast(c_custkey as varchar) as query, case c_custkey % 3 when 0 then {_json('{"data":{"stocks":["{\\\\"SecId\\\\":\\\\"s<k>\\\\",\\\\"OS001Index\\\\":\\\\"AB\\\\",\\\\"RT0EC\\\\":\\\\"FR\\\\"}"]}}')} when 1 then {_json('{"data":{"stocks":[{"SecID":"t<k>","OS001Index":""}]}}')} else {_json('{"data":{"stocks":[]}}')} end as json from customer"
KNOWN = "select 'US' || cast(c_custkey as varchar) as isin, 'T' || cast(c_custkey % 60 as varchar) as ticker, case when c_custkey % 2 = 0 then '' else c_name end as name, cast(null as varchar) as currency, 'STOCK' as type from customer where c_custkey % 5 = 0"
INCOMING = "select c_custkey as ordinal, 'US' || cast(c_custkey % 90 as varchar) as isin, 'T' || cast(c_custkey % 75 as varchar) as ticker, upper(c_name) as name, case when c_custkey % 2 = 0 then 'USD' else 'EUR' end as currency, 'ETF' as type from customer"
TWO = "select 'T' || cast(c_custkey % 50 as varchar) as ticker, case when c_custkey % 3 = 0 then 'I' || cast(c_custkey % 50 as varchar) when c_custkey % 3 = 1 then '' end as isin, c_custkey as place, case when c_custkey % 7 = 0 then 'timeout' end as error, case when c_custkey % 4 = 0 then c_custkey * 1e0 end as price, case when c_custkey % 11 = 0 then c_name end as name from customer"
#: Rows of an import with suffixes of several exchanges, listings that are stored, and addresses that one of the new ones has already.
QUOTED = "select c_custkey as ordinal, 'US' || cast(c_custkey % 1000 as varchar) as isin, 'T' || cast(c_custkey % 1000 as varchar) || case c_custkey % 6 when 0 then '.PA' when 1 then '.F' when 2 then '.XX' when 3 then '.DE' else '' end as ticker, case c_custkey % 5 when 0 then 'USD' when 1 then 'CHF' when 2 then null else 'EUR' end as currency from customer"
STORED = "select 'US' || cast(c_custkey as varchar) as isin, 'T' || cast(c_custkey as varchar) || case when c_custkey % 2 = 0 then '.PA' else '' end as ticker, case when c_custkey % 2 = 0 then 'XPAR' else '' end as exchange, case when c_custkey % 4 <> 0 then 'EUR' end as currency, c_custkey % 3 = 0 as is_primary from customer where c_custkey % 8 <> 5"
MAPPED = "select 'US' || cast(c_custkey as varchar) as isin, 'T' || cast(c_custkey as varchar) || '.PA' as ticker, 'XPAR' as exchange, 'USD' as currency, 'GoogleFinance' as provider_name from customer where c_custkey % 4 = 0"
asked, wrapped, known, incoming, stage_one, quoted, stored, mapped = map(_rows, (ASKED, WRAPPED, KNOWN, INCOMING, TWO, QUOTED, STORED, MAPPED))


def _stage_two(spark: SparkSession, d: str) -> DataFrame:
    return stage_one(spark, d).select(F.concat(F.lit("I"), F.substring("ticker", 2, 9)).alias("isin"), "place", F.lit(None).cast("string").alias("error"), (F.col("place") + 0.5).alias("price"), F.lit("later").alias("name"))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """A usage log to which two batches were added; a month's orders stand for a day's requests."""
    path = scratch_path(spark)
    o = read(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("o_orderpriority").alias("endpoint"), F.lit("GET").alias("method"), F.lit(200).alias("status_code"), F.lit(1.5).alias("latency_ms"), F.lit("p").alias("provider_used"), (F.col("o_orderkey") % 2 == 0).alias("cache_hit"), "o_orderkey")
    for k in (0, 1):
        logs.append_usage(o.where(F.col("o_orderkey") % 2 == k), path)
    return spark.read.parquet(path).groupBy("endpoint", "cache_hit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"))


DOC = f"select c_custkey as asset_id, 'T' || cast(c_custkey as varchar) || '.PA' as ticker, c_name as name, case when c_custkey % 4 = 0 then '' else c_mktsegment end as sector, case when c_custkey % 3 = 0 then 'ETF' end as quote_type, case when c_custkey % 5 <> 0 then cast(c_custkey % 30 as double) end as pe_ratio, cast(c_custkey * 1000 as double) as market_cap, {_json('{"trailingPE": <k>.5, "sector": "Other", "beta": "1.25", "recommendationKey": "buy", "targetMeanPrice": 12}')} as json, case when c_custkey % 2 = 0 then 'hold' end as consensus, cast(c_custkey % 9 as double) as target_mean, c_custkey % 7 as votes from customer"
companies = _rows(DOC)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d)
    o = read(spark, d, "orders")
    of = o.select(F.col("o_custkey").alias("asset_id"), "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderstatus")
    statements = of.groupBy("asset_id", F.year("date").alias("y")).agg(F.count(F.lit(1)).alias("n")).select("asset_id", F.when(F.col("y") % 2 == 0, "income").otherwise("balance").alias("statement_type"), F.lit("annual").alias("period_type"), F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("period_end"), (F.col("n") + 0.5).alias("figure"))
    votes = c.where("asset_id % 6 <> 0").select("asset_id", "consensus", "target_mean", *(F.col("votes").alias(x) for x in ("strong_buy", "buy", "hold", "sell", "strong_sell")))
    return document.document(
        c.select("asset_id", "ticker", "name", "sector", "quote_type"), c.select("asset_id", "pe_ratio", "market_cap"), c.select("asset_id", "json"), statements, votes,
        insiders=of.select("asset_id", "date", F.col("o_orderkey").cast("string").alias("owner"), F.lit(1.0).alias("shares"), F.col("o_orderstatus").alias("code")),
        providers=of.select("asset_id", F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("provider")).distinct().withColumns({"error": F.when(F.col("provider") == "p1", "timeout"), "ticker": F.lit("T"), "isin": F.lit("I"), "name": F.lit("N")}),
        holdings=of.select("asset_id", F.col("o_orderkey").cast("string").alias("ticker"), F.col("o_orderkey").cast("string").alias("name"), F.lit("s").alias("sector"), F.lit("c").alias("country"), F.col("o_orderkey").cast("double").alias("weight")),
    )


INFO = """{"sector": "Other", "industry": "I<k>", "website": "http://w/<k>", "fullTimeEmployees": <k>, "trailingPE": <k>.5, "forwardPE": 11, "priceToBook": 3.5, "enterpriseValue": "<k>000", "enterpriseToRevenue": 2.25, "ebitda": "<k>00", "bookValue": 4.5, "dividendRate": 2.5,
 "dividendYield": 0.02, "payoutRatio": 0.4, "lastSplitFactor": "2:1", "lastSplitDate": "2020-01-0<d>", "sharesOutstanding": "<k>0", "floatShares": "<k>1", "heldPercentInsiders": 0.1, "shortRatio": 1.5, "sharesShort": 7, "beta": "1.25", "fiftyTwoWeekHigh": 120, "fiftyTwoWeekLow": 80,
 "fiftyDayAverage": 95.5, "twoHundredDayAverage": 90.5, "recommendationKey": "buy", "targetMeanPrice": 12}""".replace("\n", "")
SECTIONS = f"select c_custkey as asset_id, 'T' || cast(c_custkey as varchar) || '.PA' as ticker, c_name as name, 'EUR' as currency, case when c_custkey % 3 = 0 then 'ETF' end as quote_type, case when c_custkey % 5 <> 0 then cast(c_custkey % 30 as double) end as pe_ratio, cast(c_custkey * 1000 as double) as market_cap, '2024-01-0' || cast(c_custkey % 9 + 1 as varchar) as dividend_ex_date, {_json(INFO).replace("<d>", "' || cast(c_custkey % 9 + 1 as varchar) || '")} as json from customer"
TRADES = "select o_custkey as asset_id, o_orderkey, cast(o_orderdate as date) as date, o_totalprice, o_orderstatus from orders"
profiles_of = _rows(SECTIONS)
#: Path in a document: what it should be in terms of the company (c) and its orders (a), as text.
_TEXTS = {
    "General.Code": "c.ticker", "General.Name": "c.name", "General.CurrencyCode": "'EUR'", "General.Industry": "'I' || c.asset_id", "General.WebURL": "'http://w/' || c.asset_id", "General.Type": "coalesce(c.quote_type, 'Common Stock')",
    "SplitsDividends.ExDividendDate": "c.dividend_ex_date", "SplitsDividends.LastSplitFactor": "'2:1'", "SplitsDividends.LastSplitDate": "'2020-01-0' || (c.asset_id % 9 + 1)", "SplitsDividends.DividendDate": "null", "Highlights.EPSEstimateNextYear": "null",
    "AnalystRatings.Rating": "case when c.asset_id % 6 = 0 then 'buy' else 'hold' end", "ESGScores.RatingDate": "case when c.asset_id % 4 = 0 then '2024-0' || (c.asset_id % 9 + 1) || '-01' end", "Holders.Institutions.0.name": "'H' || a.inst", "Holders.Institutions.0.date": "a.inst_date",
    "Holders.Funds.0.name": "'H' || a.fund", "InsiderTransactions.0.ownerName": "case when a.n is null then null when c.asset_id % 2 = 0 then 'O' || a.first else 'W' || a.first end", "InsiderTransactions.0.date": "a.first_date", "InsiderTransactions.0.transactionCode": "case when c.asset_id % 2 = 0 then a.status end",
    "InsiderTransactions.0.description": "case when a.n is null then null when c.asset_id % 2 = 0 then 'D' || a.status else 'elsewhere' end", "Providers.p0.status": "case when a.p0 then 'ok' end", "Providers.p0.provider_url": "case when a.p0 then 'http://p/' || c.asset_id end", "Providers.p0.country": "case when a.p0 then 'FR' end",
    "Providers.p1.status": "case when a.p1 then 'error' end", "Providers.p1.error": "case when a.p1 then 'timeout' end", "Providers.p1.country": "null", "Providers.p2.status": "case when a.p2 then 'no_data' end", "Providers.p2.name": "null", "ETF_Data.Top_10_Holdings.0.Symbol": "case when c.quote_type = 'ETF' then cast(a.top as varchar) end",
    "ETF_Data.Top_10_Holdings.0.Sector": "case when c.quote_type = 'ETF' and a.n > 0 then 's' end", "Earnings.History.0.reportDate": "e.y0 || '-12-31'", "Earnings.Trend.0.period": "cast(e.y0 as varchar)",
}
#: The same as numbers.
_NUMBERS = {
    "General.FullTimeEmployees": "c.asset_id", "Highlights.MarketCapitalization": "nullif(c.market_cap, 0)", "Highlights.PERatio": "coalesce(nullif(c.pe_ratio, 0), c.asset_id + 0.5e0)", "Highlights.EBITDA": "c.asset_id * 100", "Highlights.BookValue": "4.5e0", "Highlights.DividendShare": "2.5e0", "Highlights.MarketCapitalizationMln": "nullif(c.market_cap, 0) / 1e6",
    "Valuation.TrailingPE": "coalesce(nullif(c.pe_ratio, 0), c.asset_id + 0.5e0)", "Valuation.ForwardPE": "11", "Valuation.PriceBookMRQ": "3.5e0", "Valuation.EnterpriseValue": "c.asset_id * 1000", "Valuation.EnterpriseValueRevenue": "2.25e0",
    "SharesStats.SharesOutstanding": "c.asset_id * 10", "SharesStats.SharesFloat": "c.asset_id * 10 + 1", "SharesStats.PercentInsiders": "0.1e0", "SharesStats.SharesShort": "7", "SharesStats.ShortRatio": "1.5e0", "Technicals.Beta": "1.25e0", "Technicals.52WeekHigh": "120", "Technicals.52WeekLow": "80",
    "Technicals.50DayMA": "95.5e0", "Technicals.200DayMA": "90.5e0", "SplitsDividends.ForwardAnnualDividendRate": "2.5e0", "SplitsDividends.ForwardAnnualDividendYield": "0.02e0", "SplitsDividends.PayoutRatio": "0.4e0", "SplitsDividends.NumberDividendsByYear": "0",
    "AnalystRatings.TargetPrice": "case when c.asset_id % 6 = 0 then 12 else c.asset_id % 9 end", "AnalystRatings.StrongBuy": "case when c.asset_id % 6 <> 0 then c.asset_id % 7 end", "AnalystRatings.Hold": "case when c.asset_id % 6 <> 0 then 2 end", "AnalystRatings.Sell": "case when c.asset_id % 6 <> 0 then 0 end",
    "ESGScores.TotalEsg": "case when c.asset_id % 4 = 0 then c.asset_id % 50 end", "ESGScores.EnvironmentScore": "case when c.asset_id % 4 = 0 then 1 end", "ESGScores.SocialScore": "case when c.asset_id % 4 = 0 then 2 end", "ESGScores.GovernanceScore": "case when c.asset_id % 4 = 0 then 3 end", "ESGScores.ControversyLevel": "case when c.asset_id % 4 = 0 then 4 end",
    "Holders.Institutions.0.currentShares": "a.inst", "Holders.Institutions.0.totalShares": "case when a.inst is not null then 0.25e0 end", "Holders.Institutions.0.change": "case when a.inst is not null then -0.5e0 end", "Holders.Institutions.0.value": "a.inst_value", "Holders.Funds.0.value": "a.fund_value",
    "InsiderTransactions.0.shares": "a.first", "InsiderTransactions.0.transactionAmount": "case when c.asset_id % 2 = 0 then a.price end", "InsiderTransactions.0.transactionPrice": "case when c.asset_id % 2 = 0 then a.price / 4 end", "Earnings.History.0.epsActual": "e.n0", "Earnings.Trend.0.earningsEstimateAvg": "e.n0", "ETF_Data.Top_10_Holdings.0.Assets_%": "case when c.quote_type = 'ETF' then a.top end",
}


def _read_once(documents: DataFrame, paths: list[str]) -> tuple[DataFrame, Callable[[str], Column]]:
    """``documents`` with their values at ``paths``, and what gives a path's text: a document is read once, whatever the number of paths."""
    parts: dict = {}
    for path in paths:
        at = parts
        for x in path.split("."):
            at = at.setdefault(x, {})
    kind = lambda of: StructType([StructField(x, kind(below) if below else StringType()) for x, below in of.items()])

    def get(path: str) -> Column:
        c = F.col("j")
        for x in path.split("."):
            c = c.getField(x)
        return c

    return documents.select("asset_id", "document", F.from_json("document", kind(parts)).alias("j")), get


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """path, text and number of the figures of _TEXTS and _NUMBERS in each company's document."""
    c = profiles_of(spark, d)
    o = spark.sql(TRADES.replace("from orders", "from {orders}"), orders=read(spark, d, "orders"))
    year = F.year("date")
    yearly = o.groupBy("asset_id", year.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    owned = o.select("asset_id", "date", F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("owner"), F.col("o_orderkey").alias("shares"), F.col("o_orderstatus").alias("code"), F.col("o_totalprice").alias("amount"), (F.col("o_totalprice") / 4).alias("price"), F.concat(F.lit("D"), "o_orderstatus").alias("description"))
    other = o.select("asset_id", "date", F.concat(F.lit("W"), F.col("o_orderkey").cast("string")).alias("owner"), F.col("o_orderkey").alias("shares"), F.lit("elsewhere").alias("description"))
    holder = o.select("asset_id", F.when(F.col("o_orderstatus") == "F", "institutions").when(F.col("o_orderstatus") == "O", "Funds").otherwise("other").alias("category"), F.concat(F.lit("H"), F.col("o_orderkey").cast("string")).alias("holder"), F.col("date").alias("date_reported"), F.lit(0.25).alias("pct_out"), F.col("o_orderkey").alias("shares"), F.lit(-0.5).alias("change"), F.col("o_totalprice").alias("value"))
    asked = o.select("asset_id", F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("provider")).distinct().withColumns({"error": F.when(F.col("provider") == "p1", "timeout"), "has_payload": F.col("provider") != "p2", "ticker": F.lit("T"), "name": F.lit("N"), "isin": F.lit(None).cast("string"), "provider_url": F.concat(F.lit("http://p/"), F.col("asset_id").cast("string")), "country": F.lit("FR")})
    votes = c.where("asset_id % 6 <> 0").select("asset_id", F.lit("hold").alias("consensus"), (F.col("asset_id") % 9).alias("target_mean"), (F.col("asset_id") % 7).alias("strong_buy"), *(F.lit(n).alias(x) for n, x in ((1, "buy"), (2, "hold"), (0, "sell"), (0, "strong_sell"))))
    esg = c.where("asset_id % 4 = 0").select("asset_id", F.concat(F.lit("2024-0"), (F.col("asset_id") % 9 + 1).cast("string"), F.lit("-01")).alias("rating_date"), (F.col("asset_id") % 50).alias("total_esg"), *(F.lit(n).alias(x) for n, x in ((1, "environment_score"), (2, "social_score"), (3, "governance_score"), (4, "controversy_level"))))
    made = document.document(
        c.select("asset_id", "ticker", "name", "currency", "quote_type"), c.select("asset_id", "pe_ratio", "market_cap", "dividend_ex_date"), c.select("asset_id", "json"), ratings=votes, esg=esg,
        earnings=yearly.select("asset_id", F.col("y").alias("period"), F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("period_end"), F.col("n").alias("eps_actual"), *(F.lit(0.5).alias(x) for x in ("eps_estimate", "surprise", "surprise_pct"))),
        trend=yearly.select("asset_id", F.col("y").alias("period"), F.col("n").alias("eps_avg"), F.lit(1).alias("revenue_avg")), holders=holder, insiders=owned.where("asset_id % 2 = 0"), insiders_elsewhere=other, providers=asked,
        holdings=o.select("asset_id", F.col("o_orderkey").cast("string").alias("ticker"), F.col("o_orderkey").cast("string").alias("name"), F.lit("s").alias("sector"), F.lit("c").alias("country"), F.col("o_orderkey").cast("double").alias("weight")),
    )
    found, get = _read_once(made, [*_TEXTS, *_NUMBERS])
    entries = [F.struct(F.lit(x).alias("path"), get(x).alias("text"), F.lit(None).cast("double").alias("number")) for x in _TEXTS] + [F.struct(F.lit(x).alias("path"), F.lit(None).cast("string").alias("text"), steady(get(x).cast("double")).alias("number")) for x in _NUMBERS]
    return found.select("asset_id", F.explode(F.array(*entries)).alias("e")).select("asset_id", "e.*")


def _document_fields(spark: SparkSession, d: str) -> DataFrame:
    sizes = {n: F.size(F.from_json(F.get_json_object("document", f"$.{path}"), "map<string,string>")) for n, path in (("n_insiders", "InsiderTransactions"), ("n_income", "Financials.Income_Statement.yearly"), ("n_providers", "Providers"), ("n_holdings", "ETF_Data.Top_10_Holdings"))}
    texts = {"code": "General.Code", "sector": "General.Sector", "kind": "General.Type", "logo": "General.LogoURL", "rating": "AnalystRatings.Rating", "first_insider": "InsiderTransactions.0.ownerName", "top": "ETF_Data.Top_10_Holdings.0.Symbol", "failed": "Providers.p1.error"}
    figures = {"pe": "Valuation.TrailingPE", "mln": "Highlights.MarketCapitalizationMln", "beta": "Technicals.Beta", "target": "AnalystRatings.TargetPrice"}
    doc, get = _read_once(_documents(spark, d), [*texts.values(), *figures.values()])
    return doc.select("asset_id", *(get(p).alias(n) for n, p in texts.items()), *(steady(get(p).cast("double")).alias(n) for n, p in figures.items()), *(F.coalesce(F.when(c >= 0, c), F.lit(0)).cast("bigint").alias(n) for n, c in sizes.items()))


MARKED = f"""
select c_custkey as key, case c_custkey % 4 when 0 then 'fscore' when 1 then 'mscore' when 2 then 'ROIC' else 'gf_score' end as code, '<style>p 99</style><p>Score is <b>-' || cast(c_custkey as varchar) || '.5</b> of 10</p>' as score,
  '<div class="x c-faceplate__isin y"> ISIN : FR' || cast(c_custkey as varchar) || ' </div><ul><li>PEA</li><li><b>SRD</b> long</li><li>PEA</li><li>other</li></ul><div class="c-gauge" data-gauge-steps="7" data-gauge-current-step="' || cast(c_custkey % 7 as varchar) || '"><b class="c-gauge__label">Low ' || cast(c_custkey as varchar) || '</b></div>'
  || '<div><span>Niveau de Controverse</span> <strong>N' || cast(c_custkey % 3 as varchar) || '</strong></div><div><span>Impact positif</span><strong> P </strong></div>' as equity,
  '<h1 id="etf-title"> Fund ' || cast(c_custkey as varchar) || ' </h1><div data-testid="etf-profile-header_distribution-policy-value">' || case c_custkey % 3 when 0 then 'Thesaurierend' when 1 then 'Distributing' else 'Other' end || '</div><div data-testid="etf-profile-header_ter-value">0,' || cast(c_custkey % 9 + 1 as varchar)
  || '0% p.a.</div><span data-testid="etf-profile-header_holdings-value">1.' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') || '</span><span data-testid="etf-profile-header_fund-size-value-wrapper">EUR 1.234 m</span>' as fund,
  'x(["A headline of ' || cast(c_custkey as varchar) || '", "https://n/' || cast(c_custkey as varchar) || case when c_custkey % 5 = 0 then '.css' else '' end || '", "S", "3 hours ago"], ["short", "https://n", "", ""])' as news,
  'T' || cast(c_custkey as varchar) || case c_custkey % 3 when 0 then '.PA' when 1 then '' else '.ZZ' end as ticker, case c_custkey % 4 when 0 then 'XPAR' when 1 then 'NAS' else 'LSE' end as exchange from customer
"""
marked = _rows(MARKED)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    m = marked(spark, d).where("key % 5 <> 0")
    bare = F.concat(F.lit("t"), F.col("key").cast("string"))
    first = m.select(bare.alias("query"), F.lit(1).alias("place"), F.lit("fund").alias("type"), bare.alias("symbol"), F.lit("PAR").alias("exchange"))
    return first.unionByName(m.select(bare.alias("query"), F.lit(2).alias("place"), F.lit("stock").alias("type"), bare.alias("symbol"), "exchange"))


RECORDS = "select c_custkey, c_name, case when c_custkey % 3 <> 0 then c_mktsegment end as segment from customer"
def _company_lists(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("asset_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("shares"), (F.col("o_orderkey") % 7).alias("weight"))
    made = fundamentals.with_lists(read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id")), share_counts=o.select("asset_id", "date", "shares"), holdings=o.select("asset_id", "weight", "shares"))
    n = F.size("share_counts")
    return made.select("asset_id", F.when(n > 0, n).otherwise(0).cast("bigint").alias("n_counts"), F.get("share_counts", 0)["shares"].alias("newest"), F.array_join(F.transform("holdings", lambda x: x["shares"].cast("string")), ",").alias("held"))


NEW = f"""with s as ({STORED}), q as (select isin, ticker, case split_part(ticker, '.', 2) when 'PA' then 'XPAR' when 'F' then 'XFRA' when 'DE' then 'XETR' else '' end as exchange, currency, min(ordinal) as ordinal from ({QUOTED}) group by 1, 2, 3, 4),
  n as (select * from q where not exists (select 1 from s where s.isin = q.isin and s.ticker = q.ticker and s.exchange is not distinct from q.exchange and s.currency is not distinct from q.currency)),
  g as (select isin, bool_or(is_primary) as any_primary from s group by 1),
  r as (select n.*, any_primary, row_number() over (partition by isin order by ordinal) as place, min(case when currency in ('USD', 'GBP', 'JPY', 'CHF', 'CAD', 'AUD') then ordinal end) over (partition by isin) as main from n left join g using (isin)),
  f as (select isin, ticker, exchange, currency, ordinal, case when any_primary is null then place = 1 when any_primary then false else coalesce(ordinal = main, false) end as is_primary from r)"""

QUERIES = {
    "parse_fields": (
        lambda spark, d: texts(spark, d).select(
            "id", dates.us_date("us").alias("day"), dates.quarter_label(dates.us_date("us")).alias("quarter"), web.without_footnotes("noted").alias("bare"), numbers.last_number(web.without_footnotes("noted")).alias("last"), numbers.safe_int("whole").alias("whole"), numbers.padded_ticker("code").alias("code"),
            web.slug("title").alias("slug"), web.isin_in("isins").alias("isin"), F.array_join(names.every_group("pairs", "([a-z]+[0-9]*)=([0-9]+)", 2), ",").alias("pairs"), dates.epoch_time("seconds").cast("timestamp_ntz").alias("at"), fundamentals.consensus_label({"buy": "Buy", "hold": "Hold", "sell": "Sell"}).alias("label")),
        f"""with t as ({TEXTS}), u as (select *, make_date(2024, cast(id % 12 + 1 as int), cast(id % 28 + 1 as int)) as day from t)
        select id, day, '2024Q' || cast((id % 12) // 3 + 1 as varchar) as quarter, cast(id % 31 as varchar) || ' of ' || cast(id as varchar) || '.5 shares' as bare, id + 0.5e0 as last,
          case id % 4 when 0 then null when 1 then cast('1' || cast(id as varchar) as bigint) else id end as whole, case when id % 3 = 0 then code when length(code) <= 5 then lpad(code, 5, '0') else code end as code, 'ete-no-' || cast(id as varchar) || '-ca' as slug,
          'US' || lpad(cast(id as varchar), 10, '0') as isin, 'a' || cast(id as varchar) || ',1,b,' || cast(id % 7 as varchar) as pairs, make_timestamp(id * 1000 * 1000000) as at,
          case when greatest(buy, hold, coalesce(sell, 0)) = 0 then null when buy = greatest(buy, hold, coalesce(sell, 0)) then 'Buy' when hold = greatest(buy, hold, coalesce(sell, 0)) then 'Hold' else 'Sell' end as label from u""",
    ),
    "index_members": (
        lambda spark, d: pages.index_members(page(spark, d).select(F.concat(F.lit("i"), F.col("key").cast("string")).alias("index_name"), "html")),
        "select 'i' || cast(c_custkey as varchar) as index_name, 'T' || cast(c_custkey as varchar) as ticker, 'Firm ' || cast(c_custkey as varchar) as name, 'S' || cast(c_custkey % 9 as varchar) as sector from customer",
    ),
    "html_label_values": (
        lambda spark, d: page(spark, d).select("key", F.explode(web.label_values("html")).alias("c")).select("key", "c.label", "c.value").where("label = 'Beta'"),
        "select c_custkey as key, 'Beta' as label, cast(c_custkey % 7 as varchar) || '.5' as value from customer",
    ),
    "html_cards": (
        lambda spark, d: page(spark, d).select("key", F.explode(web.cards("html")).alias("c")).select("key", "c.title", "c.url", "c.time"),
        "select c_custkey as key, 'News of ' || cast(c_custkey as varchar) as title, '/n/' || cast(c_custkey as varchar) as url, '2024-01-0' || cast(c_custkey % 9 + 1 as varchar) as time from customer",
    ),
    "form4_transactions": (
        lambda spark, d: form(spark, d).select("key", F.explode(web.form4("xml")).alias("t")).select("key", "t.owner", "t.date", "t.code", "t.type", "t.shares", "t.price", "t.total"),
        """select c_custkey as key, 'Owner ' || cast(c_custkey as varchar) as owner, '2024-02-0' || cast(c_custkey % 9 + 1 as varchar) as date, case c_custkey % 3 when 0 then 'P' when 1 then 'S' else 'Q' end as code, case c_custkey % 3 when 0 then 'Buy' when 1 then 'Sell' else 'Q' end as type,
        cast(c_custkey as double) as shares, case when c_custkey % 4 <> 0 then 2.5e0 end as price, case when c_custkey % 4 <> 0 then c_custkey * 2.5e0 end as total from customer where c_custkey % 10 <> 0""",
    ),
    "quote_frames": (
        lambda spark, d: web.quote_frames(form(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz")),
        "select make_timestamp(c_custkey * 1000000) as ts, 1.5e0 as open, 3e0 as high, 1e0 as low, 2e0 as close, cast(10 as bigint) as volume from customer",
    ),
    "insider_filings": (
        lambda spark, d: pages.insider_filings(form(spark, d).select(F.col("key").alias("cik"), F.col("filings").alias("json")), 1),
        "select lpad(cast(c_custkey as varchar), 10, '0') as cik, date '2024-03-01' as filed, 'c' || cast(c_custkey as varchar) as accession from customer",
    ),
    "identifier_mappings": (
        lambda spark, d: pages.identifier_mappings(form(spark, d).select(F.array(F.concat(F.lit("I"), F.col("key").cast("string")), F.lit("none")).alias("isins"), F.col("mapped").alias("json"))),
        "select 'I' || cast(c_custkey as varchar) as isin, 'F' || cast(c_custkey as varchar) as figi, 'T' || cast(c_custkey as varchar) as ticker, 'US' as exchange from customer",
    ),
    "feed_articles": (
        lambda spark, d: pages.feed_articles(form(spark, d).select(F.col("feed").alias("json")), "bing").withColumn("published_at", F.col("published_at").cast("timestamp_ntz")),
        "select 'News ' || cast(c_custkey as varchar) as title, 'http://n/' || cast(c_custkey as varchar) as url, 'S' as source, timestamp '2024-01-02 03:04:05' as published_at, 'en' as language, 'bing' as provider, 'http://i/' || cast(c_custkey as varchar) as image from customer",
    ),
    "fund_profile": (
        lambda spark, d: pages.fund_profile(form(spark, d).select("key", F.col("fund").alias("json"))).select("key", steady("ter").alias("ter"), steady("size", 0).alias("size"), "currency", F.get("holdings", 0)["name"].alias("holding"), steady(F.get("holdings", 0)["weight"]).alias("weight")),
        "select c_custkey as key, 0.002e0 as ter, c_custkey * 1e6 + 5e5 as size, 'EUR' as currency, 'H' || cast(c_custkey as varchar) as holding, 0.125e0 as weight from customer",
    ),
    "recent_closes": (
        lambda spark, d: assets.recent_closes(brand_bars(spark, d).withColumn("resolution", F.lit("1D")), read(spark, d, "part").select(F.col("p_brand").alias("asset"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("ticker")).distinct(), "1998-06-01").withColumn("close", steady("close")),
        f"with b as ({BRAND}) select replace(asset, 'Brand#', 'B') as ticker, ts, {steady_sql('close')} as close from b where ts >= '1998-06-01'",
    ),
    "estimates": (
        lambda spark, d: _estimates(spark, d).select("asset_id", "period", steady("eps").alias("eps"), steady("revenue", 2).alias("revenue")),
        f"with o as (select o_custkey as asset_id, year(o_orderdate) as period, max(o_totalprice) as x from orders group by 1, 2) select asset_id, period, {steady_sql('x / 1e4')} as eps, {steady_sql('x', 2)} as revenue from o where period % 2 = 0 and period > 1995",
    ),
    "resolve_alert": (
        lambda spark, d: assets.resolve_alert(alerts(spark, d).withColumn("resolved_at", F.col("resolved_at").cast("timestamp_ntz")), [4, 5, 6], "2024-02-01 00:00:00"),
        f"with a as ({ALERTS}) select alert_id, case when alert_id in (4, 5, 6) then coalesce(resolved_at, timestamp '2024-02-01') else resolved_at end as resolved_at from a",
    ),
    "profile_fill": (
        lambda spark, d: identity.filled(profile(spark, d), read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.lit("new").alias("sector"), F.upper("c_mktsegment").alias("name")).where("asset_id % 7 <> 0"), "asset_id", ["sector", "name"]),
        f"with p as ({PROFILE}) select asset_id, coalesce(nullif(sector, ''), case when asset_id % 7 <> 0 then 'new' end) as sector, coalesce(nullif(name, ''), case when asset_id % 7 <> 0 then upper(c_mktsegment) end) as name from p join customer on c_custkey = asset_id",
    ),
    "stored_bars": (
        _written_bars,
        f"with b as ({BRAND}) select asset, strftime(ts, '%Y-%m') as month, count(*) as n, cast(sum(volume) as bigint) as volume from b where strftime(ts, '%Y-%m') between '1996-03' and '1996-08' group by 1, 2",
    ),
    "records_csv": (lambda spark, d: _written_records(spark, d, "csv"), RECORDS),
    "records_json": (lambda spark, d: _written_records(spark, d, "json"), RECORDS),
    "stream_subscribed": (
        lambda spark, d: ticks.available_now(ticks.subscribed(tick_stream(spark, d), read(spark, d, "events").select(F.col("event_type").alias("asset")).distinct().withColumn("is_active", F.col("asset") < "q")).select("event_id", "asset", "price"), "append"),
        "select event_id, event_type as asset, value as price from events where event_type < 'q'",
    ),
    "stream_fresh_values": (
        lambda spark, d: ticks.fresh(ticks.available_now(ticks.last_values(tick_stream(spark, d)), "update", ["asset"]), "2024-01-30 23:50:00", 1800).withColumn("ts", F.col("ts").cast("timestamp_ntz")),
        "select event_type as asset, arg_max(value, row(ts, event_id)) as price, max(ts) as ts from events group by 1 having max(ts) > timestamp '2024-01-30 23:50:00' - interval 1800 second",
    ),
    "requested_providers": (
        lambda spark, d: fundamentals.requested_providers(asked(spark, d).select("request_id", F.split("names", ",").alias("names")), PROVIDERS),
        f"""with a as ({ASKED}) select request_id, unnest(['Google', 'nobody']) as provider, unnest([null, 'Provider not found']) as error from a where request_id % 4 = 0
        union all select request_id, unnest(['Zonebourse', 'Google', 'Barrons']), null from a where request_id % 4 = 1 union all select request_id, 'Zonebourse', null from a where request_id % 4 > 1""",
    ),
    "market_terms": (
        lambda spark, d: asked(spark, d).select("request_id", web.news_language("ticker").alias("language"), web.market_country("ticker").alias("country"), *(pages.bars_to_ask(F.col("days"), r).alias(f"n_{r[-1].lower()}") for r in ("1D", "1W", "1M")), names.short_company("company").alias("company")),
        f"""with a as ({ASKED}) select request_id, case request_id % 3 when 0 then 'fr' when 1 then 'sv' else 'en' end as language, case request_id % 3 when 0 then 'fr' when 1 then 'se' end as country, greatest(10, days) as n_d, greatest(5, days // 7 + 5) as n_w, greatest(5, days // 30 + 5) as n_m,
        case when request_id % 2 = 0 then 'Foo Ltd Inc' else 'Societe AB' end as company from a""",
    ),
    "wrapped_hits": (
        lambda spark, d: pages.wrapped_hits(wrapped(spark, d)),
        "select 'Q' || cast(c_custkey as varchar) as query, case c_custkey % 3 when 0 then 's' else 't' end || cast(c_custkey as varchar) as id, case c_custkey % 3 when 0 then 'ab-fr-stock' else 'q' || cast(c_custkey as varchar) || '-stock' end as slug from customer where c_custkey % 3 < 2",
    ),
    "two_stage_merge": (
        lambda spark, d: fundamentals.two_stage(stage_one(spark, d), _stage_two(spark, d), ["price", "name"]),
        f"""with o as ({TWO}), g as (select * from o where error is null), f as (select ticker, arg_min(isin, place) filter (where isin <> '') as isin from g group by 1),
        s as (select 'I' || substr(ticker, 2) as isin, place, place + 0.5e0 as price, 'later' as name from o), b as (select ticker, 1 as st, place, price, name from g union all select f.ticker, 2, s.place, s.price, s.name from f join s using (isin)),
        m as (select ticker, arg_min(price, row(st, place)) filter (where price is not null) as price, arg_min(name, row(st, place)) filter (where name is not null) as name from b group by 1) select ticker, isin, price, name from f left join m using (ticker)""",
    ),
    "import_assets": (
        lambda spark, d: identity.imported(known(spark, d), incoming(spark, d))[0],
        f"""with k as ({KNOWN}), r as ({INCOMING}), f as (select * from r qualify row_number() over (partition by isin order by ordinal) = 1), n as (select * from f anti join k using (isin)),
        p as (select *, row_number() over (partition by ticker order by ordinal) > 1 or ticker in (select ticker from k) as again from n)
        select isin, case when again then isin else ticker end as ticker, name, currency, type, 'created' as how from p
        union all select k.isin, k.ticker, coalesce(nullif(k.name, ''), f.name), coalesce(k.currency, f.currency), k.type, case when f.isin is null then 'kept' else 'updated' end from k left join f using (isin)""",
    ),
    "import_listings": (lambda spark, d: identity.imported(known(spark, d), incoming(spark, d))[1], f"with r as ({INCOMING}) select isin, ticker, currency, min(ordinal) as ordinal from r group by 1, 2, 3"),
    "import_new_listings": (lambda spark, d: imports.new_listings(stored(spark, d), quoted(spark, d)), f"{NEW} select isin, ticker, exchange, currency, ordinal, is_primary from f"),
    "import_mappings": (
        lambda spark, d: imports.default_mappings(imports.new_listings(stored(spark, d), quoted(spark, d)), mapped(spark, d)),
        f"""{NEW}, m as ({MAPPED}), u as (
          select isin, ticker, exchange, currency, 'YahooFinance' as provider_name, 'https://finance.yahoo.com/quote/' || ticker as provider_url from f where ticker like '%.%' or currency in ('USD', 'GBP', 'JPY', 'CHF', 'CAD', 'AUD')
          union all select isin, ticker, exchange, currency, 'GoogleFinance', 'https://www.google.com/finance/quote/' || split_part(ticker, '.', 1) || case exchange when 'XPAR' then ':EPA' else ':ETR' end from f where exchange in ('XPAR', 'XETR'))
        select isin, ticker, exchange, currency, provider_name, ticker as provider_ticker, provider_url, 'csv_import' as source, 1e0 as confidence_score from u
        where not exists (select 1 from m where m.isin = u.isin and m.ticker = u.ticker and m.exchange = u.exchange and m.currency = u.currency and m.provider_name = u.provider_name)""",
    ),
    "listing_search": (
        lambda spark, d: identity.listing_search(listings(spark, d), currency="usd", n=25).select("listing_id", "ticker"),
        f"with l as ({LISTING}) select listing_id, ticker from l where currency = 'USD' order by is_primary desc, ticker, currency, exchange, listing_id limit 25",
    ),
    "dup_summary": (
        lambda spark, d: identity.duplicate_summary(listings(spark, d).select("asset_id", "isin").distinct()),
        f"with l as (select distinct asset_id, isin from ({LISTING})), s as (select isin, count(*) as n from l where isin is not null group by 1) select cast(sum(n) as bigint) as with_isin, count(*) filter (where n > 1) as duplicated, cast(coalesce(sum(n) filter (where n > 1), 0) as bigint) as affected from s",
    ),
    "mapping_mentions": (
        lambda spark, d: assets.mentioned(read(spark, d, "customer").select(F.col("c_custkey").alias("mapping_id"), F.concat(F.lit("http://x/T"), F.col("c_custkey").cast("string")).alias("value")), "T1"),
        "select c_custkey as mapping_id, 'http://x/T' || cast(c_custkey as varchar) as value from customer where 'http://x/T' || cast(c_custkey as varchar) like '%/T1%'",
    ),
    "usage_log": (_usage, "select o_orderpriority as endpoint, o_orderkey % 2 = 0 as cache_hit, count(*) as n, count(distinct date_trunc('month', o_orderdate)) as days from orders group by 1, 2"),
    "recent_failures": (
        lambda spark, d: logs.newest(read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("happened")), "happened", "o_orderkey", 30),
        "select o_orderkey, cast(o_orderdate as timestamp) as happened from orders where o_orderstatus = 'F' order by cast(o_orderdate as timestamp) desc, o_orderkey desc limit 30",
    ),
    "known_names": (
        lambda spark, d: logs.known_names(read(spark, d, "nation").select(F.col("n_name").alias("name")), read(spark, d, "region").select(F.col("r_name").alias("name"))),
        "select n_name as name from nation union select r_name from region",
    ),
    "quote_status": (
        lambda spark, d: fundamentals.quote_status(ticks_of(spark, d).select("asset").distinct(), ticks_of(spark, d), "2024-01-30 23:50:00", 1800),
        "select event_type as asset, case when max(ts) >= timestamp '2024-01-30 23:50:00' - interval 1800 second then 'realtime' else 'delayed' end as status from events group by 1",
    ),
    "dynamic_bounds": (
        lambda spark, d: quality.with_dynamic_bounds(quality.bounds(spark, {"price": (0.0, 9.0), "pe_ratio": (0.5, 1000.0)}), quality.dynamic_range(brand_bars(spark, d))).select("asset", "field", steady("low", 2).alias("low"), steady("high", 2).alias("high")),
        f"""with b as ({BRAND}), s as (select asset, avg(close) as m, 3 * greatest(stddev_samp(close), avg(close) * 0.02e0) as k from b group by 1 having count(close) >= 10)
        select asset, 'price' as field, {steady_sql("greatest(m - k, 0.01e0)", 2)} as low, {steady_sql("m + k", 2)} as high from s union all select asset, 'pe_ratio', 0.5e0, 1000e0 from s""",
    ),
    "company_document": (_documents, None),
    "company_document_fields": (
        _document_fields,
        f"""with c as ({DOC}), o as (select *, row_number() over (partition by o_custkey order by cast(o_orderdate as date), cast(o_orderkey as varchar)) as rn from orders),
        a as (select o_custkey as asset_id, count(*) as n, max(o_orderkey) as top, max(case when rn = 1 then cast(o_orderkey as varchar) end) as first, count(distinct case when year(o_orderdate) % 2 = 0 then year(o_orderdate) end) as y, count(distinct o_orderkey % 3) as p, bool_or(o_orderkey % 3 = 1) as bad from o group by 1)
        select asset_id, ticker as code, case when sector = '' then 'Other' else sector end as sector, coalesce(quote_type, 'Common Stock') as kind, '/static/logos/UNKNOWN/T' || cast(asset_id as varchar) || '.webp' as logo, case when asset_id % 6 = 0 or consensus is null then 'buy' else consensus end as rating,
          first as first_insider, case when quote_type = 'ETF' then cast(top as varchar) end as top, case when bad then 'timeout' end as failed, {steady_sql("coalesce(nullif(pe_ratio, 0), asset_id + 0.5e0)")} as pe, {steady_sql("nullif(market_cap, 0) / 1e6")} as mln, 1.25e0 as beta,
          {steady_sql("case when asset_id % 6 = 0 then 12 else target_mean end")} as target, coalesce(n, 0) as n_insiders, coalesce(y, 0) as n_income, coalesce(p, 0) as n_providers, case when quote_type = 'ETF' then least(coalesce(n, 0), 10) else 0 end as n_holdings
        from c left join a using (asset_id)""",
    ),
    "company_sections": (
        _sections,
        f"""with c as ({SECTIONS}), o as (select *, row_number() over (partition by asset_id order by date, case when asset_id % 2 = 0 then 'O' else 'W' end || cast(o_orderkey as varchar)) as rn, year(date) as y from ({TRADES})),
        k as (select asset_id, y, count(*) as n from o group by 1, 2), e as (select asset_id, min(y) as y0, arg_min(n, y) as n0 from k group by 1),
        a as (select asset_id, count(*) as n, max(case when rn = 1 then o_orderkey end) as first, cast(max(case when rn = 1 then date end) as varchar) as first_date, max(case when rn = 1 then o_orderstatus end) as status, max(case when rn = 1 then o_totalprice end) as price, max(o_orderkey) as top,
          arg_max(o_orderkey, o_totalprice) filter (where o_orderstatus = 'F') as inst, cast(arg_max(date, o_totalprice) filter (where o_orderstatus = 'F') as varchar) as inst_date, max(o_totalprice) filter (where o_orderstatus = 'F') as inst_value,
          arg_max(o_orderkey, o_totalprice) filter (where o_orderstatus = 'O') as fund, max(o_totalprice) filter (where o_orderstatus = 'O') as fund_value, bool_or(o_orderkey % 3 = 0) as p0, bool_or(o_orderkey % 3 = 1) as p1, bool_or(o_orderkey % 3 = 2) as p2 from o group by 1)
        select asset_id, x.path as path, x.t as text, x.v as number from (select c.asset_id, unnest([{", ".join([f"{{'path': '{p}', 't': cast({e} as varchar), 'v': cast(null as double)}}" for p, e in _TEXTS.items()] + [f"{{'path': '{p}', 't': cast(null as varchar), 'v': cast({steady_sql(e)} as double)}}" for p, e in _NUMBERS.items()])}]) as x from c left join a using (asset_id) left join e using (asset_id))""",
    ),
    "page_scores": (
        lambda spark, d: profiles.page_scores(marked(spark, d).select((F.col("key") - F.col("key") % 4).alias("key"), "code", F.col("score").alias("html"))),
        """select c_custkey - c_custkey % 4 as key, cast(max(case when c_custkey % 4 = 0 then -c_custkey end) as int) as piotroski_score, max(case when c_custkey % 4 = 1 then -c_custkey - 0.5e0 end) as beneish_m_score,
        max(case when c_custkey % 4 = 2 then -c_custkey - 0.5e0 end) as roic, max(case when c_custkey % 4 = 3 then -c_custkey - 0.5e0 end) as gf_score from customer group by 1""",
    ),
    "exchange_symbols": (
        lambda spark, d: profiles.exchange_first_symbol(marked(spark, d).select("ticker"), _hits(spark, d)),
        f"""with m as ({MARKED}), h as (select *, 'T' || cast(key as varchar) as bare, key % 5 <> 0 as has from m)
        select ticker, case when has then exchange || ':' || case when key % 3 = 1 or (key % 3 = 0 and exchange = 'XPAR') then bare else 't' || cast(key as varchar) end when key % 3 = 0 then 'XPAR:' || bare when key % 3 = 1 then 'NAS:' || bare end as symbol from h""",
    ),
    "equity_profile": (
        lambda spark, d: profiles.equity_profile(marked(spark, d).select("key", F.col("equity").alias("html"))).withColumn("eligibility", F.array_join("eligibility", ",")),
        """select c_custkey as key, 'FR' || cast(c_custkey as varchar) as isin, 'PEA,SRD long' as eligibility, 'Low ' || cast(c_custkey as varchar) as esg_score, cast(c_custkey % 7 as varchar) || '/7' as risk_level, 'N' || cast(c_custkey % 3 as varchar) as esg_controversy,
        null as esg_co2, 'P' as esg_positive_impact, null as esg_negative_impact from customer""",
    ),
    "fund_page": (
        lambda spark, d: profiles.fund_page(marked(spark, d).select("key", F.col("fund").alias("html"))),
        """select c_custkey as key, 'Fund ' || cast(c_custkey as varchar) as name, case c_custkey % 3 when 0 then 'Capitalisation' when 1 then 'Distribution' else 'Other' end as policy, (c_custkey % 9 + 1) / 1e1 as fees, cast(1000 + c_custkey % 1000 as int) as holdings, '1 234 m' as size from customer""",
    ),
    "embedded_articles": (
        lambda spark, d: profiles.embedded_articles(marked(spark, d).select("key", F.col("news").alias("html")), "2026-05-20 10:00:00"),
        "select c_custkey as key, 'A headline of ' || cast(c_custkey as varchar) as title, 'https://n/' || cast(c_custkey as varchar) as url, 'S' as source, timestamp '2026-05-20 07:00:00' as published_at from customer where c_custkey % 5 <> 0",
    ),
    "company_lists": (
        _company_lists,
        """with o as (select o_custkey as asset_id, cast(o_orderdate as date) as date, o_orderkey as shares, o_orderkey % 7 as weight from orders),
        r as (select *, row_number() over (partition by asset_id order by date desc, shares) as a, row_number() over (partition by asset_id order by weight desc, shares) as b from o),
        g as (select asset_id, count(*) as n, max(case when a = 1 then shares end) as newest, string_agg(cast(shares as varchar), ',' order by b) filter (where b <= 100) as held from r group by 1)
        select c_custkey as asset_id, coalesce(least(n, 100), 0) as n_counts, newest, held from customer left join g on asset_id = c_custkey""",
    ),
}
