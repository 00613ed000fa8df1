"""Fundamentals: statements from wide frames, merges across providers, nested documents, quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite

from .bars import ranked

#: Statement line: column. Of lines for the same column the first with a value counts. Fixed values.
LINES = [
    ("Total Revenue", "revenue"), ("Gross Profit", "gross_profit"), ("EBITDA", "ebitda"), ("Operating Income", "operating_income"), ("Net Income", "net_income"), ("Basic EPS", "eps_basic"),
    ("Diluted EPS", "eps_diluted"), ("Total Assets", "total_assets"), ("Total Liabilities Net Minority Interest", "total_liabilities"), ("Total Equity Gross Minority Interest", "total_equity"),
    ("Total Debt", "total_debt"), ("Cash And Cash Equivalents", "cash_and_equivalents"), ("Cash Cash Equivalents And Short Term Investments", "cash_and_equivalents"),
    ("Operating Cash Flow", "operating_cashflow"), ("Investing Cash Flow", "investing_cashflow"), ("Financing Cash Flow", "financing_cashflow"), ("Free Cash Flow", "free_cashflow"), ("Capital Expenditure", "capex"),
]
COLUMNS = list(dict.fromkeys(c for _, c in LINES))


def unpivoted(wide: DataFrame, keys: list[str], periods: list[str]) -> DataFrame:
    """keys, period, value: a row for each period column that has a value."""
    return wide.unpivot(keys, [F.col(f"`{p}`") for p in periods], "period", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def statements(lines: DataFrame) -> DataFrame:
    """asset_id, period and COLUMNS from ``lines`` (asset_id, label, period, value)."""
    rank = {label: i for i, (label, _) in enumerate(LINES)}
    order = F.try_element_at(F.create_map(*(F.lit(x) for pair in rank.items() for x in pair)), F.col("label"))
    ranked_lines = lines.withColumn("_rank", order).where(F.col("_rank").isNotNull() & F.col("value").isNotNull())
    picked = [F.min_by(F.when(F.col("label").isin([a for a, b in LINES if b == c]), F.col("value")), F.when(F.col("label").isin([a for a, b in LINES if b == c]), F.col("_rank"))).alias(c) for c in COLUMNS]
    return ranked_lines.groupBy("asset_id", "period").agg(*picked)


def merged(rows: DataFrame, key: str, priority: str, columns: list[str]) -> DataFrame:
    """A row for each ``key``: of each column the value of the first provider by ``priority`` that has one."""
    return rows.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(priority))).alias(c) for c in columns))


def requested_providers(requests: DataFrame, known: list[str]) -> DataFrame:
    """request_id, provider, error: the names of ``requests`` (request_id, names: array) as they are known, whatever their case; none asked for means all, unknown ones have an error."""
    names = F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: n != "")
    asked = requests.select("request_id", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(*map(F.lit, known)))).alias("name"))
    table = F.create_map(*(F.lit(x) for n in known for x in (n.lower(), n)))
    found = F.try_element_at(table, F.lower("name"))
    return asked.select("request_id", F.coalesce(found, "name").alias("provider"), F.when(found.isNull(), "Provider not found").alias("error"))


def two_stage(by_ticker: DataFrame, by_isin: DataFrame, columns: list[str]) -> DataFrame:
    """ticker, isin and ``columns``: of each the value of the first provider that has one, those asked by ticker before those asked by the ISIN that the former found.

    ``by_ticker`` has ticker, isin, place, error and ``columns``, ``by_isin`` isin, place, error and ``columns``; results with an error don't count.
    """
    good = by_ticker.where("error is null")
    found = good.groupBy("ticker").agg(F.min_by("isin", F.when(F.col("isin") != "", F.col("place"))).alias("isin"))
    later = found.join(by_isin.where("error is null"), "isin").select("ticker", F.struct(F.lit(2).alias("stage"), "place").alias("_p"), *columns)
    both = good.select("ticker", F.struct(F.lit(1).alias("stage"), "place").alias("_p"), *columns).unionByName(later)
    return found.join(merged(both, "ticker", "_p", columns), "ticker", "left")


#: Column of the highlights: key of a provider's info document. Fixed values.
HIGHLIGHTS = {
    "market_cap": "marketCap", "enterprise_value": "enterpriseValue", "pe_ratio": "trailingPE", "pe_forward": "forwardPE", "pb_ratio": "priceToBook", "ps_ratio": "priceToSalesTrailing12Months", "peg_ratio": "pegRatio",
    "ev_ebitda": "enterpriseToEbitda", "ev_revenue": "enterpriseToRevenue", "roe": "returnOnEquity", "roa": "returnOnAssets", "roic": "returnOnCapital", "net_margin": "profitMargins", "operating_margin": "operatingMargins",
    "gross_margin": "grossMargins", "eps_trailing": "trailingEps", "eps_forward": "forwardEps", "book_value_per_share": "bookValue", "revenue_per_share": "revenuePerShare", "dividend_yield": "dividendYield",
    "dividend_rate": "dividendRate", "payout_ratio": "payoutRatio", "beta": "beta", "week_52_high": "fiftyTwoWeekHigh", "week_52_low": "fiftyTwoWeekLow", "ma_50": "fiftyDayAverage", "ma_200": "twoHundredDayAverage",
    "shares_outstanding": "sharesOutstanding", "float_shares": "floatShares", "pct_insiders": "heldPercentInsiders", "pct_institutions": "heldPercentInstitutions", "shares_short": "sharesShort",
    "shares_short_prior": "sharesShortPriorMonth", "short_ratio": "shortRatio", "short_percent_float": "shortPercentOfFloat", "gross_profit_ttm": "grossProfits", "quarterly_revenue_growth_yoy": "revenueGrowth",
    "quarterly_earnings_growth_yoy": "earningsGrowth", "revenue_ttm": "totalRevenue", "ebitda_ttm": "ebitda",
}
WHOLE = ["shares_outstanding", "float_shares", "shares_short", "shares_short_prior"]


def highlights(documents: DataFrame) -> DataFrame:
    """asset_id and HIGHLIGHTS from info documents (asset_id, json); what is no finite number is null."""
    info = F.from_json("json", "map<string,string>")
    number = lambda key: finite(F.try_element_at("_info", F.lit(key)).try_cast("double"))
    rows = documents.select("asset_id", info.alias("_info"))
    return rows.select("asset_id", *((number(k).try_cast("bigint") if c in WHOLE else number(k)).alias(c) for c, k in HIGHLIGHTS.items()))


def sections(companies: DataFrame, statement_rows: DataFrame, earnings: DataFrame, latest_statements: int = 5, latest_earnings: int = 10) -> DataFrame:
    """asset_id, highlights (a struct), statements and earnings (arrays, newest first): what a page of a company shows, in one row."""
    def newest(rows: DataFrame, name: str, n: int) -> DataFrame:
        kept = ranked(rows, ["asset_id"], [F.desc("period")], n)
        entry = F.struct("period", *(c for c in rows.columns if c not in ("asset_id", "period")))
        return kept.groupBy("asset_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias(name))

    head = companies.select("asset_id", F.struct(*(c for c in companies.columns if c != "asset_id")).alias("highlights"))
    return head.join(newest(statement_rows, "statements", latest_statements), "asset_id", "left").join(newest(earnings, "earnings", latest_earnings), "asset_id", "left")


#: Lists of a company's page: column they are ordered by (the largest first), and how many are shown. Fixed values.
LISTS = {"ratings": ("date", 1), "esg": ("date", 1), "trend": ("period", 10), "share_counts": ("date", 100), "holdings": ("weight", 100)}


def with_lists(head: DataFrame, **lists: DataFrame) -> DataFrame:
    """``head`` (asset_id, ...) with an array for each of ``lists`` (names of LISTS; asset_id and columns), cut and ordered as LISTS says; ties go by the other columns."""
    out = head
    for name, rows in lists.items():
        by, n = LISTS[name]
        others = [c for c in rows.columns if c not in ("asset_id", by)]
        kept = ranked(rows, ["asset_id"], [F.col(by).desc_nulls_last(), *others], n)
        held = F.array_sort(F.collect_list(F.struct(by, *others)), lambda a, b: F.when(a[by] > b[by], -1).when(a[by] < b[by], 1).when(a[others[0]] < b[others[0]], -1).when(a[others[0]] > b[others[0]], 1).otherwise(0))
        out = out.join(kept.groupBy("asset_id").agg(held.alias(name)), "asset_id", "left")
    return out


def consensus_label(votes: dict[str, str]) -> object:
    """The label with the most votes, by column; the first of ``votes`` wins a tie, and none has a label without votes."""
    best = F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in votes))
    out = F.lit(None).cast("string")
    for c, label in reversed(votes.items()):
        out = F.when((best > 0) & (F.col(c) == best), label).otherwise(out)
    return out


def document(companies: DataFrame, statement_rows: DataFrame, most: int = 5) -> DataFrame:
    """asset_id and document: a nested JSON text with general figures and the latest statements by period."""
    kept = ranked(statement_rows, ["asset_id"], [F.desc("period")], most)
    entry = F.struct(F.col("period").cast("string").alias("period"), F.struct(*(F.col(c) for c in statement_rows.columns if c not in ("asset_id", "period"))).alias("row"))
    nested = kept.groupBy("asset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("Financials"))
    general = F.struct(*(F.col(c) for c in companies.columns if c != "asset_id")).alias("General")
    joined = companies.select("asset_id", general).join(nested, "asset_id", "left")
    return joined.select("asset_id", F.to_json(F.struct("General", "Financials"), {"ignoreNullFields": "false"}).alias("document"))


def quotes(bars: DataFrame) -> DataFrame:
    """asset, price, previous, change, change_pct from the last two bars of each asset."""
    newest = Window.partitionBy("asset").orderBy(F.desc("ts"))
    last = bars.select("asset", "close", F.row_number().over(newest).alias("rn")).where("rn <= 2")
    out = last.groupBy("asset").agg(F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("price"), F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("previous"))
    change = F.col("price") - F.col("previous")
    return out.withColumns({"change": change, "change_pct": 100 * F.try_divide(change, F.col("previous"))})


def quote_status(quoted: DataFrame, newest: DataFrame, as_of: str, seconds: int = 900) -> DataFrame:
    """``quoted`` with status: realtime where the asset's newest tick (asset, ts) is at most ``seconds`` old, else delayed."""
    last = newest.groupBy("asset").agg(F.max("ts").alias("_ts"))
    recent = F.col("_ts") >= F.expr(f"timestamp_ntz'{as_of}' - interval {int(seconds)} seconds")
    return quoted.join(last, "asset", "left").withColumn("status", F.when(recent, "realtime").otherwise("delayed")).drop("_ts")


def stale(active: DataFrame, ticks: DataFrame, as_of: str, seconds: int = 60) -> DataFrame:
    """asset, is_stale: active assets without a tick in the ``seconds`` before ``as_of``."""
    fresh = ticks.where(F.col("ts") > F.expr(f"timestamp_ntz'{as_of}' - interval {int(seconds)} seconds")).select("asset").distinct().withColumn("_f", F.lit(True))
    return active.select("asset").join(fresh, "asset", "left").select("asset", F.col("_f").isNull().alias("is_stale"))
