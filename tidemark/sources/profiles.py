"""Profiles, scores and articles from provider pages whose HTML marks its values by ids and classes: column expressions over the page's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers
from tidemark.functions.numbers import col
from tidemark.operators.bars import ranked

#: Code of a score's page: column. Fixed values.
SCORES = {"fscore": "piotroski_score", "mscore": "beneish_m_score", "ROIC": "roic", "gf_score": "gf_score"}
#: What a fund page says of dividends: what it stands for. Fixed values.
POLICIES = {"Ausschüttend": "Distribution", "Distribution": "Distribution", "Distributing": "Distribution", "Thesaurierend": "Capitalisation", "Accumulating": "Capitalisation", "Capitalisation": "Capitalisation"}
#: Part of a label on an equity page: column. Fixed values.
LABELS = {"controverse": "esg_controversy", "co₂": "esg_co2", "positif": "esg_positive_impact", "négatif": "esg_negative_impact"}

#: Exchange code of the site that puts exchanges first: suffix of its tickers. Fixed values.
EXCHANGE_SUFFIX = {
    "XPAR": ".PA", "XAMS": ".AS", "XBRU": ".BR", "XLIS": ".LS", "XMAD": ".MC", "MIL": ".MI", "XSWX": ".SW", "FRA": ".F", "XTER": ".DE", "LSE": ".L",
    "TSE": ".T", "HKSE": ".HK", "SHSE": ".SS", "SZSE": ".SZ", "ASX": ".AX", "TSX": ".TO", "TSXV": ".V", "XCNQ": ".CN", "NEOE": ".NE", "BSP": ".SA",
    "MEX": ".MX", "BUE": ".BA", "XSGO": ".SN", "BOG": ".CL", "JSE": ".JO", "BOM": ".BO", "NSE": ".NS", "SGX": ".SI", "TPE": ".TW", "ROCO": ".TWO",
    "XKRX": ".KS", "BKK": ".BK", "XKLS": ".KL", "ISX": ".JK", "HSTC": ".VN", "XTAE": ".TA", "SAU": ".SAU", "OSTO": ".ST", "OSL": ".OL", "OHEL": ".HE",
    "OCSE": ".CO", "WBO": ".VI", "DUB": ".IR", "ATH": ".AT", "IST": ".IS", "WAR": ".WA", "XPRA": ".PR", "BUD": ".BD", "CAI": ".CA",
    "NAS": "", "NYSE": "", "AMEX": "", "ARCA": "", "GREY": "", "OTCBB": "", "OTCPK": "",
}
#: Of exchanges without a suffix only this one is taken where no hit tells. Fixed value.
HOME = "NAS"


def plain_text(html: Column | str) -> Column:
    """Without scripts, styles and tags; blanks are single."""
    bare = F.regexp_replace(F.regexp_replace(col(html), r"(?is)<(script|style)\b.*?</\1>", " "), "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def marked(html: Column | str, attribute: str, value: str) -> Column:
    """Text of the first element whose ``attribute`` holds ``value`` as a word, up to the next tag; null where there is none."""
    found = F.regexp_extract(col(html), rf'(?s)<[^>]*\b{attribute}="(?:[^"]*\s)?\Q{value}\E(?:\s[^"]*)?"[^>]*>\s*([^<]*)', 1)
    return F.nullif(F.trim(found), F.lit(""))


def page_scores(pages: DataFrame) -> DataFrame:
    """key and SCORES from ``pages`` (key, code, html): the first number of each page's text."""
    first = F.regexp_extract(plain_text("html"), r"([-+]?[0-9]*\.[0-9]+|[0-9]+)", 1).try_cast("double")
    told = pages.select("key", "code", first.alias("value"))
    made = told.groupBy("key").agg(*(F.min(F.when(F.col("code") == code, F.col("value"))).alias(name) for code, name in SCORES.items()))
    return made.withColumn("piotroski_score", F.col("piotroski_score").cast("int"))


def exchange_first_symbol(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """ticker, symbol as ``EXCHANGE:SYMBOL`` for each of ``requests`` (ticker) from ``hits`` (query, place, type, symbol, exchange) of its bare symbol.

    A ticker with an exchange in front stays. Of stocks the first whose exchange has the ticker's suffix counts, or without a suffix the first of the very symbol; then the first of
    the very symbol, as it is spelled; then the exchange that has the suffix (without one: NAS). Other tickers get none.
    """
    pieces = F.split("ticker", r"\.")
    parts = requests.select("ticker", F.get(pieces, F.lit(0)).alias("bare"), F.coalesce(F.concat(F.lit("."), F.upper(F.get(pieces, F.lit(1)))), F.lit("")).alias("suffix"))
    known = F.create_map(*(F.lit(x) for pair in EXCHANGE_SUFFIX.items() for x in pair))
    stocks = hits.where("type = 'stock'").select(F.upper("query").alias("_query"), "place", "symbol", "exchange")
    met = parts.join(stocks, F.upper("bare") == F.col("_query"))
    very = F.upper(F.coalesce("symbol", F.lit(""))) == F.upper("bare")
    fits = F.when(F.col("suffix") == "", very).otherwise(F.coalesce(F.try_element_at(known, F.upper("exchange")) == F.col("suffix"), F.lit(False)))
    best = ranked(met.withColumn("way", F.when(fits, 1).when(very, 2)).where("way is not null"), ["ticker"], [F.col("way"), F.col("place")])
    spelled = lambda c: F.when(F.col("way") == 1, F.upper(c)).otherwise(F.col(c))
    named = best.select("ticker", F.concat_ws(":", F.nullif(spelled("exchange"), F.lit("")), spelled("symbol")).alias("found"))
    first: dict[str, str] = {"": HOME}
    for exchange, suffix in EXCHANGE_SUFFIX.items():
        first.setdefault(suffix, exchange)
    of_suffix = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    made = F.concat(F.try_element_at(of_suffix, F.col("suffix")), F.lit(":"), F.col("bare"))
    joined = parts.join(named, "ticker", "left")
    return joined.select("ticker", F.when(F.col("ticker").contains(":"), F.col("ticker")).otherwise(F.coalesce("found", made)).alias("symbol"))


def equity_profile(pages: DataFrame) -> DataFrame:
    """key, isin, eligibility (texts in order), esg_score, risk_level and LABELS from ``pages`` (key, html)."""
    items = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<li\b[^>]*>(.*?)</li>"), F.lit(1)), plain_text)
    badges = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.rlike("PEA|SRD|CTO") & (F.length(x) < 50))))
    pairs = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(r"(?s)<span\b[^>]*>([^<]*)</span>\s*<strong\b[^>]*>([^<]*)</strong>"), F.lit(g)).alias(n) for g, n in ((1, "label"), (2, "value"))))
    value = lambda part: F.trim(F.get(F.filter(pairs, lambda p: F.lower(p["label"]).contains(part)), 0)["value"])
    step = lambda name: F.nullif(F.regexp_extract("html", rf'data-gauge-{name}="([0-9]+)"', 1), F.lit(""))
    isin = F.trim(F.replace(marked("html", "class", "c-faceplate__isin"), F.lit("ISIN :"), F.lit("")))
    return pages.select("key", isin.alias("isin"), badges.alias("eligibility"), marked("html", "class", "c-gauge__label").alias("esg_score"), F.concat(step("current-step"), F.lit("/"), step("steps")).alias("risk_level"), *(value(part).alias(name) for part, name in LABELS.items()))


def fund_page(pages: DataFrame) -> DataFrame:
    """key, name, policy, fees (percent, 0 where unknown), holdings (0 where unknown), size from ``pages`` (key, html)."""
    of = lambda what: marked("html", "data-testid", f"etf-profile-header_{what}")
    policy = of("distribution-policy-value")
    table = F.create_map(*(F.lit(x) for pair in POLICIES.items() for x in pair))
    fees = F.replace(F.regexp_replace(F.replace(F.lower(of("ter-value")), F.lit("p.a."), F.lit("")), r"[\s%]", ""), F.lit(","), F.lit(".")).try_cast("double")
    count = F.regexp_replace(of("holdings-value"), r"[\s.,]", "").try_cast("int")
    size = F.trim(F.regexp_replace(of("fund-size-value-wrapper"), "EUR|USD|GBP|CHF|JPY", ""))
    return pages.select("key", marked("html", "id", "etf-title").alias("name"), F.coalesce(F.try_element_at(table, policy), policy).alias("policy"), F.coalesce(fees, F.lit(0.0)).alias("fees"), F.coalesce(count, F.lit(0)).alias("holdings"), F.replace(size, F.lit("."), F.lit(" ")).alias("size"))


def embedded_articles(pages: DataFrame, now: str) -> DataFrame:
    """key, title, url, source, published_at of the arrays of title, address, source and time in ``pages`` (key, html); addresses of files of a page's layout are left out."""
    shape = r'(?s)\["([^"]{10,500})",\s*"(https?://[^"]+)",\s*"([^"]*)",\s*"([^"]*)"'
    found = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(shape), F.lit(g)).alias(n) for g, n in ((1, "title"), (2, "url"), (3, "source"), (4, "time"))))
    rows = pages.select("key", F.inline(found)).where(~F.col("url").rlike(r"\.(?:css|js|png|jpg|svg)"))
    return rows.select("key", "title", "url", numbers.first_present("source").alias("source"), dates.english_date("time", now).alias("published_at"))
