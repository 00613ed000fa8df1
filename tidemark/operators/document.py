"""The nested document of a company: sections of figures, each with its fallback, and numbered or dated lists, as one JSON text for each asset.

Lists are aggregated by asset before they are joined, so a document is a row and a company's lists are all that meets in it; their lengths are
bounded by what a company has (statements, ratings, holders). The joins go by sorted partitions of the assets, however small an input seems: a document costs far more than its
rows' bytes tell, so it is made where its asset was dealt to. What an input lacks is null in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import first_present, plain_number

#: Section: key of the document, column of the highlights (None: none), key of the info document (None: none). Fixed values.
FIGURES: dict[str, list[tuple[str, str | None, str | None]]] = {
    "Highlights": [
        ("MarketCapitalization", "market_cap", "marketCap"), ("EBITDA", "ebitda_ttm", "ebitda"), ("PERatio", "pe_ratio", "trailingPE"), ("PEGRatio", "peg_ratio", "pegRatio"), ("WallStreetTargetPrice", None, "targetMeanPrice"),
        ("BookValue", "book_value_per_share", "bookValue"), ("DividendShare", "dividend_rate", "dividendRate"), ("DividendYield", "dividend_yield", "dividendYield"), ("EarningsShare", "eps_trailing", "trailingEps"),
        ("EPSEstimateCurrentYear", None, "forwardEps"), ("ProfitMargin", "net_margin", "profitMargins"), ("OperatingMarginTTM", "operating_margin", "operatingMargins"), ("ReturnOnAssetsTTM", "roa", "returnOnAssets"),
        ("ReturnOnEquityTTM", "roe", "returnOnEquity"), ("RevenueTTM", "revenue_ttm", "totalRevenue"), ("RevenuePerShareTTM", "revenue_per_share", "revenuePerShare"), ("QuarterlyRevenueGrowthYOY", "quarterly_revenue_growth_yoy", "revenueGrowth"),
        ("QuarterlyEarningsGrowthYOY", "quarterly_earnings_growth_yoy", "earningsGrowth"), ("GrossProfitTTM", "gross_profit_ttm", "grossProfits"), ("DilutedEpsTTM", "diluted_eps_ttm", "trailingEps"),
    ],
    "Valuation": [
        ("TrailingPE", "pe_ratio", "trailingPE"), ("ForwardPE", "pe_forward", "forwardPE"), ("PriceSalesTTM", "ps_ratio", "priceToSalesTrailing12Months"), ("PriceBookMRQ", "pb_ratio", "priceToBook"),
        ("EnterpriseValue", "enterprise_value", "enterpriseValue"), ("EnterpriseValueRevenue", "ev_revenue", "enterpriseToRevenue"), ("EnterpriseValueEbitda", "ev_ebitda", "enterpriseToEbitda"),
    ],
    "SharesStats": [
        ("SharesOutstanding", "shares_outstanding", "sharesOutstanding"), ("SharesFloat", "float_shares", "floatShares"), ("PercentInsiders", "pct_insiders", "heldPercentInsiders"), ("PercentInstitutions", "pct_institutions", "heldPercentInstitutions"),
        ("SharesShort", "shares_short", "sharesShort"), ("SharesShortPriorMonth", "shares_short_prior", "sharesShortPriorMonth"), ("ShortRatio", "short_ratio", "shortRatio"), ("ShortPercentFloat", "short_percent_float", "shortPercentOfFloat"),
        ("ShortPercentOutstanding", "short_percent_outstanding", "sharesPercentSharesOut"),
    ],
    "Technicals": [
        ("Beta", "beta", "beta"), ("52WeekHigh", "week_52_high", "fiftyTwoWeekHigh"), ("52WeekLow", "week_52_low", "fiftyTwoWeekLow"), ("50DayMA", "ma_50", "fiftyDayAverage"), ("200DayMA", "ma_200", "twoHundredDayAverage"),
        ("SharesShort", "shares_short", "sharesShort"), ("SharesShortPriorMonth", "shares_short_prior", "sharesShortPriorMonth"), ("ShortRatio", "short_ratio", "shortRatio"), ("ShortPercent", "short_percent_float", "shortPercentOfFloat"),
    ],
    "SplitsDividends": [("ForwardAnnualDividendRate", "dividend_rate", "dividendRate"), ("ForwardAnnualDividendYield", "dividend_yield", "dividendYield"), ("PayoutRatio", "payout_ratio", "payoutRatio")],
}
#: Key of General: column of the profile (None: none), key of the info document (None: none). Fixed values.
GENERAL: list[tuple[str, str | None, str | None]] = [
    ("Code", "ticker", "symbol"), ("Name", "name", "longName"), ("Exchange", "exchange", None), ("CurrencyCode", "currency", "currency"), ("CountryName", "country", None), ("CountryISO", "country_code", None), ("ISIN", "isin", "isin"),
    ("PrimaryTicker", "ticker", None), ("CIK", None, "cik"), ("FiscalYearEnd", None, "fiscalYearEnd"), ("Sector", "sector", "sector"), ("Industry", "industry", "industry"), ("GicSector", "gic_sector", None), ("GicGroup", "gic_group", None),
    ("GicIndustry", "gic_industry", None), ("GicSubIndustry", "gic_sub_industry", None), ("Description", "long_business_summary", None), ("Address", None, "address1"), ("Phone", None, "phone"), ("WebURL", None, "website"), ("FullTimeEmployees", None, "fullTimeEmployees"),
]
#: Keys that are always null, by section, and the key of a count that is always 0. Fixed values.
NONE = {"Highlights": ["EPSEstimateNextYear", "EPSEstimateNextQuarter", "EPSEstimateCurrentQuarter", "MostRecentQuarter", "QuarterlyEarningsShareGrowthYOY"]}
#: Key of SplitsDividends that is a text: column of the highlights (None: none), key of the info document (None: none). Fixed values.
SPLITS = [("DividendDate", "dividend_pay_date", None), ("ExDividendDate", "dividend_ex_date", None), ("LastSplitFactor", None, "lastSplitFactor"), ("LastSplitDate", None, "lastSplitDate")]
#: Statement type: section of Financials. Fixed values.
STATEMENTS = {"income": "Income_Statement", "balance": "Balance_Sheet", "cashflow": "Cash_Flow"}


def numbered(rows: DataFrame, name: str, order: list[Column], entry: Column, most: int | None = None) -> DataFrame:
    """asset_id and ``name``: a map from 0, 1, ... to each row's ``entry``, in ``order``."""
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    held = F.sort_array(F.collect_list(F.struct(place.alias("o"), entry.alias("e"))))
    held = held if most is None else F.slice(held, 1, most)
    made = F.map_from_entries(F.transform(held, lambda x, i: F.struct(i.cast("string").alias("key"), x["e"].alias("value"))))
    return rows.groupBy("asset_id").agg(made.alias(name))


def financials(statements: DataFrame) -> DataFrame:
    """asset_id and Financials from ``statements`` (asset_id, statement_type, period_type, period_end, and figures): by section, yearly or quarterly, and date; figures as texts."""
    figures = [c for c in statements.columns if c not in ("asset_id", "statement_type", "period_type", "period_end")]
    entry = F.struct(F.col("period_end").cast("string").alias("key"), F.struct(*(plain_number(c).alias(c) for c in figures)).alias("value"))
    annual = F.col("period_type") == "annual"
    of = lambda kind, yearly: F.map_from_entries(F.sort_array(F.collect_list(F.when((F.col("statement_type") == kind) & (annual if yearly else ~annual), entry))))
    sections = [F.struct(of(kind, True).alias("yearly"), of(kind, False).alias("quarterly")).alias(name) for kind, name in STATEMENTS.items()]
    return statements.groupBy("asset_id").agg(F.struct(*sections).alias("Financials"))


def document(
    profiles: DataFrame, highlights: DataFrame, infos: DataFrame, statements: DataFrame | None = None, ratings: DataFrame | None = None, esg: DataFrame | None = None, earnings: DataFrame | None = None, trend: DataFrame | None = None,
    holders: DataFrame | None = None, insiders: DataFrame | None = None, providers: DataFrame | None = None, holdings: DataFrame | None = None, insiders_elsewhere: DataFrame | None = None,
) -> DataFrame:
    """asset_id and document (JSON).

    ``profiles`` has asset_id, quote_type and columns of GENERAL, ``highlights`` asset_id and columns of FIGURES, ``infos`` asset_id and json. A figure of 0 counts as none,
    so its fallback is asked. The others have a row for each entry: ``ratings`` (consensus, target_mean, strong_buy, buy, hold, sell, strong_sell), ``esg`` (rating_date, total_esg,
    environment_score, social_score, governance_score, controversy_level), ``earnings`` (period, period_end, eps_actual, eps_estimate, surprise, surprise_pct), ``trend`` (period, eps_avg,
    revenue_avg), ``holders`` (category, holder, date_reported, pct_out, shares, change, value), ``insiders`` (date, owner, shares, code, amount, price, description), ``providers`` (provider, has_payload, error, ticker, isin, name,
    provider_url, country), ``holdings`` (ticker, name, sector, country, weight). Columns that these lack are null. ``insiders_elsewhere`` (date, owner, shares, description) serves companies without ``insiders``. Keys without a
    value are null in the text, but those of Providers are left out; lists without entries are empty.
    """
    h = highlights.select("asset_id", F.struct(*(c for c in highlights.columns if c != "asset_id")).alias("_h"))
    j = infos.select("asset_id", F.from_json("json", "map<string,string>").alias("_j"))
    p = profiles.select("asset_id", F.struct(*(c for c in profiles.columns if c != "asset_id")).alias("_p"))
    df = p.join(h.hint("merge"), "asset_id", "left").join(j.hint("merge"), "asset_id", "left")

    def number(column: str | None, key: str | None) -> Column:
        own = F.col(f"_h.{column}").cast("double") if column in highlights.columns else F.lit(None).cast("double")
        other = F.try_element_at("_j", F.lit(key)).try_cast("double") if key else F.lit(None).cast("double")
        return F.coalesce(F.nullif(own, F.lit(0.0)), other)

    def text(column: str | None, key: str | None) -> Column:
        own = [F.col(f"_p.{column}").cast("string")] if column in profiles.columns else []
        return first_present(*own, *([F.try_element_at("_j", F.lit(key))] if key else []), F.lit(None).cast("string"))

    kind = first_present(text("quote_type", None), F.lit("Common Stock"))
    logo = F.concat(F.lit("/static/logos/"), first_present(text("exchange", None), F.lit("UNKNOWN")), F.lit("/"), F.upper(F.substring_index(text("ticker", "symbol"), ".", 1)), F.lit(".webp"))
    sections = {"General": F.struct(*(text(c, k).alias(name) for name, c, k in GENERAL), kind.alias("Type"), logo.alias("LogoURL"))}
    for name, figures in FIGURES.items():
        sections[name] = F.struct(*(number(c, k).alias(key) for key, c, k in figures))
    cap = number("market_cap", "marketCap")
    sections["Highlights"] = F.struct(*(number(c, k).alias(key) for key, c, k in FIGURES["Highlights"]), (cap / 1e6).alias("MarketCapitalizationMln"), *(F.lit(None).cast("double").alias(k) for k in NONE["Highlights"]))
    of_highlights = lambda c: F.col(f"_h.{c}").cast("string") if c in highlights.columns else F.lit(None).cast("string")
    splits = (F.coalesce(of_highlights(c), F.try_element_at("_j", F.lit(k)) if k else F.lit(None).cast("string")).alias(name) for name, c, k in SPLITS)
    sections["SplitsDividends"] = F.struct(*(number(c, k).alias(key) for key, c, k in FIGURES["SplitsDividends"]), *splits, F.lit(0).alias("NumberDividendsByYear"))

    def listed(rows: DataFrame | None, name: str, order: list[str], fields: dict[str, str], most: int | None = None, descending: bool = False) -> None:
        nonlocal df
        if rows is None:
            return
        entry = F.struct(*((F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(key) for key, c in fields.items()))
        by = [F.struct(F.col(o).isNull().alias("none"), (-F.col(o) if descending and i == 0 else F.col(o)).alias("x")) for i, o in enumerate(order)]
        df = df.join(numbered(rows, f"_{name}", by, entry, most).hint("merge"), "asset_id", "left")
        sections[name] = F.coalesce(F.col(f"_{name}"), F.create_map().cast(df.schema[f"_{name}"].dataType))

    def single(rows: DataFrame | None, name: str, fields: dict[str, str], extra: dict[str, Column]) -> None:
        nonlocal df
        if rows is not None:
            df = df.join(rows.groupBy("asset_id").agg(F.min(F.struct(*(F.col(c).alias(c) for c in fields.values()))).alias(f"_{name}")).hint("merge"), "asset_id", "left")
        own = {key: (F.col(f"_{name}.{c}") if rows is not None else F.lit(None).cast("string")) for key, c in fields.items()}
        sections[name] = F.struct(*((F.coalesce(c, extra[key].cast(dict(rows.dtypes)[fields[key]]) if rows is not None else extra[key]) if key in extra else c).alias(key) for key, c in own.items()))

    info = lambda key: F.try_element_at("_j", F.lit(key))
    single(ratings, "AnalystRatings", {"Rating": "consensus", "TargetPrice": "target_mean", "StrongBuy": "strong_buy", "Buy": "buy", "Hold": "hold", "Sell": "sell", "StrongSell": "strong_sell"}, {"Rating": info("recommendationKey"), "TargetPrice": info("targetMeanPrice")})
    single(esg, "ESGScores", {"RatingDate": "rating_date", "TotalEsg": "total_esg", "EnvironmentScore": "environment_score", "SocialScore": "social_score", "GovernanceScore": "governance_score", "ControversyLevel": "controversy_level"}, {})
    listed(earnings, "History", ["period_end", "period"], {"reportDate": "period_end", "date": "period", "epsActual": "eps_actual", "epsEstimate": "eps_estimate", "epsDifference": "surprise", "surprisePercent": "surprise_pct"})
    listed(trend, "Trend", ["period"], {"period": "period", "earningsEstimateAvg": "eps_avg", "revenueEstimateAvg": "revenue_avg", "epsTrendCurrent": "eps_avg"})
    sections["Earnings"] = F.struct(*(sections.pop(n).alias(n) for n in ("History", "Trend") if n in sections), F.create_map().cast("map<string,string>").alias("Annual"))
    for category in ("Institutions", "Funds"):
        listed(None if holders is None else holders.where(F.lower("category") == category.lower()), category, ["value", "holder"], {"name": "holder", "date": "date_reported", "totalShares": "pct_out", "currentShares": "shares", "change": "change", "value": "value"}, descending=True)
    if holders is not None:
        sections["Holders"] = F.struct(*(sections.pop(n).alias(n) for n in ("Institutions", "Funds")))
    trades = insiders
    if insiders_elsewhere is not None:
        trades = insiders_elsewhere if insiders is None else insiders.unionByName(insiders_elsewhere.join(insiders.select("asset_id").distinct(), "asset_id", "left_anti"), allowMissingColumns=True)
    told = {"date": "date", "ownerName": "owner", "shares": "shares", "transactionCode": "code", "transactionAmount": "amount", "transactionPrice": "price", "description": "description"}
    listed(trades, "InsiderTransactions", ["date", "owner"], told)
    if statements is not None:
        df = df.join(financials(statements).hint("merge"), "asset_id", "left")
        sections["Financials"] = F.col("Financials")
    if providers is not None:
        failed = F.coalesce(F.col("error") != "", F.lit(False))
        none = ~F.coalesce("has_payload", F.lit(False)) if "has_payload" in providers.columns else F.lit(False)
        status = F.when(failed, "error").when(none, "no_data").otherwise("ok")
        fields = {"status": status, "error": F.when(failed, F.col("error")), **{c: F.when(~failed & ~none, F.col(c).cast("string")) for c in ("ticker", "isin", "name", "provider_url", "country") if c in providers.columns}}
        entry = F.map_filter(F.create_map(*(x for k, c in fields.items() for x in (F.lit(k), c))), lambda _, v: v.isNotNull())
        df = df.join(providers.groupBy("asset_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("provider").alias("key"), F.to_json(entry).alias("value"))))).alias("_p_texts")).hint("merge"), "asset_id", "left")
        df = df.withColumn("_providers", F.transform_values(F.coalesce("_p_texts", F.create_map().cast("map<string,string>")), lambda _, v: F.from_json(v, "map<string,string>")))
        sections["Providers"] = F.col("_providers")
    listed(holdings, "Top_10_Holdings", ["weight", "name"], {"Symbol": "ticker", "Name": "name", "Sector": "sector", "Country": "country", "Assets_%": "weight"}, 10, descending=True)
    if holdings is not None:
        sections["ETF_Data"] = F.when(F.upper(kind) == "ETF", F.struct(sections.pop("Top_10_Holdings").alias("Top_10_Holdings")))
    return df.select("asset_id", F.to_json(F.struct(*(c.alias(n) for n, c in sections.items())), {"ignoreNullFields": "false"}).alias("document"))
