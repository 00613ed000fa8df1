"""Fields of provider pages by rules over the page's tree, with the state of each page; what a page lacks is filled from the search hit that led to it.

A page that can't be read is a row with an error and costs no other page anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.functions.pagetree import Rule, picked, table_rows, tree

_NEAR = "div, span, td, li"
_PE, _YIELD, _EPS = ("P/E Ratio", "Price/Earnings"), ("Yield", "Dividend Yield"), ("EPS", "Earnings Per Share")
_NEARBY = [Rule("pe_ratio", "near", _NEAR, _PE), Rule("dividend_yield", "near", _NEAR, _YIELD), Rule("eps", "near", _NEAR, _EPS)]
_NAME = Rule("name", "text", "h1")
#: Field: parts of a table row's label in lower case; the first one that fits counts. Fixed values, in order of precedence.
ROWS = {
    "revenue": ("chiffre d'affaires", "net sales"), "net_income": ("résultat net", "net income"), "eps": ("bna", "bpa", "eps"), "pe_ratio": ("per", "p/e"), "dividend_yield": ("rendement", "yield"), "ebitda": ("ebitda",),
    "operating_margin": ("marge d'exploitation", "operating margin"), "profit_margin": ("marge nette", "net margin"),
}
#: Provider: its rules; of two rules for a field the first that finds something counts. Labels and selectors are fixed values.
RULES: dict[str, list[Rule]] = {
    "zonebourse": [
        _NAME, Rule("ticker", "after colon", "li, td, div, span", ("ISIN",)), Rule("sector", "after colon", "li, td, div, span", ("Secteur",)), Rule("sector", "after colon", "li, td, div, span", ("Sector",)), Rule("esg_score", "text", ".esg-rank"),
        Rule("", "rows", "table tr", tuple((label, field) for field, labels in ROWS.items() for label in labels)),
    ],
    "barrons": [_NAME, Rule("pe_ratio", "pair", "div", _PE), Rule("dividend_yield", "pair", "div", _YIELD), Rule("eps", "pair", "div", _EPS), *_NEARBY],
    "wallstreetjournal": [_NAME, *_NEARBY],
    "marketwatch": [_NAME, *_NEARBY],
    "morningstar": [
        Rule("name", "text", "h1 span"), Rule("sector", "next", ".sal-dp-name, h3", ("secteur",)), Rule("industry", "next", ".sal-dp-name, h3", ("industrie",)), Rule("market_cap", "next", ".sal-dp-name, h3", ("cap. boursi", "capitalisation")),
        Rule("pe_ratio", "next", ".sal-dp-name, h3", ("cours/bénéfices", "price/earnings")), Rule("dividend_yield", "next", ".sal-dp-name, h3", ("rendement div", "dividend yield")), Rule("price_text", "text", "#message-box-price"),
    ],
    "investing": [_NAME, Rule("pe_ratio", "term", "", ("P/E Ratio",)), Rule("eps", "term", "", ("EPS",)), Rule("dividend_yield", "term", "", ("Dividend Yield",))],
    "fortuneo": [_NAME],
    "boursedirect": [_NAME, Rule("price", "text", ".quotation-last"), Rule("change_percent", "text", ".quotation-variation"), Rule("ticker", "text", ".sticker.sticker-default-reverse"), Rule("isin", "attribute", 'meta[property="og:description"]', ("content",))],
    "investir": [
        _NAME, Rule("price", "text", "span.typography-secondary-2xl-regular"), Rule("change_percent", "text", "span.typography-secondary-2xl-bold"),
        Rule("ticker", "attribute", 'link[rel="canonical"]', ("href",)), Rule("isin", "attribute", 'link[rel="canonical"]', ("href",)),
    ],
    "boursorama": [_NAME, Rule("isin", "text", ".c-faceplate__isin"), Rule("esg_score", "text", ".c-gauge__label")],
    "googlefinance": [_NAME],
    "msn": [_NAME],
}
TEXTS = ["name", "ticker", "isin", "sector", "industry", "esg_score", "market_cap", "price_text"]
FIGURES = ["price", "change_percent", "pe_ratio", "dividend_yield", "eps", "revenue", "net_income", "ebitda", "operating_margin", "profit_margin"]
#: A column for each field: its first text, or the texts of all its rows for the fields that tables have.
_FOUND = f"struct<{','.join(f'{field}:{"array<string>" if field in ROWS else "string"}' for field in TEXTS + FIGURES)},error:string>"


def _picked(html: pd.Series, provider: pd.Series) -> pd.DataFrame:
    found, errors = {field: [] for field in TEXTS + FIGURES}, []
    for page, name in zip(html, provider):
        met: dict[str, list[str]] = {}
        try:
            if page is None or name not in RULES:
                raise ValueError("no page" if page is None else "no rules")
            root = tree(page)
            if next(root.inside(), None) is None:
                raise ValueError("no element")
            for one in picked(root, RULES[name]):
                met.setdefault(one["field"], []).append(one["text"])
            errors.append(None)
        except Exception as error:  # whatever a page does to the parser is told in its own row
            errors.append(f"{type(error).__name__}: {error}")
        for field, column in found.items():
            texts = met.get(field)
            column.append(texts and (texts if field in ROWS else texts[0]))
    return pd.DataFrame({**found, "error": errors})


def _isin(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "([A-Z]{2}[A-Z0-9]{9}[0-9])", 1), F.lit(""))


def _number(text: Column) -> Column:
    """A figure written with a comma or a point, blanks between thousands, and perhaps a sign of percent or currency."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s  %$€+]", ""), ",", ".").try_cast("double")


def _of_rows(texts: str) -> Column:
    """The first number of a row's cells; of several rows the last that has one counts."""
    first = F.transform(texts, lambda text: F.get(F.filter(F.transform(F.split(text, "\n"), numbers.french_number), lambda x: x.isNotNull()), F.lit(0)))
    return F.try_element_at(F.filter(first, lambda x: x.isNotNull()), F.lit(-1))


CANONICAL = r"(?i)-([a-z0-9]+)-([a-z0-9]{12})-[a-z0-9]+$"


def provider_fields(pages: DataFrame) -> DataFrame:
    """key, provider, status (ok, no_data, error), error, TEXTS and FIGURES from ``pages`` (key, provider, html)."""
    made = pages.select("key", "provider", F.pandas_udf(_picked, _FOUND)("html", F.lower("provider")).alias("r"))

    def told(field: str) -> Column:
        return F.get(f"r.{field}", F.lit(0)) if field in ROWS else F.col(f"r.{field}")

    provider, columns = F.lower("provider"), {}
    for field in TEXTS:
        columns[field] = F.nullif(F.trim(told(field)), F.lit(""))
    url = provider == "investir"
    columns["ticker"] = F.when(url, F.nullif(F.upper(F.regexp_extract(columns["ticker"], CANONICAL, 1)), F.lit(""))).otherwise(columns["ticker"])
    columns["isin"] = F.when(url, F.nullif(F.upper(F.regexp_extract(columns["isin"], CANONICAL, 2)), F.lit(""))).otherwise(_isin(columns["isin"]))
    for field in FIGURES:
        columns[field] = _number(told(field))
        if field in ROWS:
            columns[field] = F.when(provider == "zonebourse", _of_rows(f"r.{field}")).otherwise(columns[field])
    out = made.select("key", "provider", F.col("r.error").alias("error"), *(c.alias(n) for n, c in columns.items()))
    status = F.when(F.col("error").isNotNull(), "error").when(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNull(), "no_data").otherwise("ok")
    return out.select("key", "provider", status.alias("status"), "error", *columns)


def filled(fields: DataFrame, hits: DataFrame) -> DataFrame:
    """``fields`` (as ``provider_fields`` gives them) whose missing values are those of ``hits`` (key, provider and some of the columns, one row for each key and provider)."""
    both = [c for c in hits.columns if c in fields.columns and c not in ("key", "provider", "status", "error")]
    named = hits.select(F.col("key").alias("_key"), F.col("provider").alias("_provider"), *(F.col(c).alias(f"_{c}") for c in both))
    joined = fields.join(named, F.col("key").eqNullSafe(F.col("_key")) & F.col("provider").eqNullSafe(F.col("_provider")), "left")
    out = {c: F.coalesce(c, F.col(f"_{c}").cast(dict(fields.dtypes)[c])) for c in both}
    told = F.coalesce(*(F.col(f"_{c}").cast("string") for c in both)).isNotNull() if both else F.lit(False)
    out["status"] = F.when((F.col("status") != "ok") & told, "ok").otherwise(F.col("status"))
    return joined.withColumns(out).select(fields.columns)


def _insiders(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in html:
        summary, recent = [], []
        for page in pages:
            root = tree(page or "")
            summary.append([dict(zip(("timeframe", "transactions", "shares"), r)) for r in table_rows(root, "table.cr_mod_insider", 3)])
            recent.append([dict(zip(("date", "owner", "shares", "description", "value"), r)) for r in table_rows(root, "table.cr_mod_transactions", 5)])
        yield pd.DataFrame({"summary": summary, "transactions": recent})


def insider_tables(pages: DataFrame) -> DataFrame:
    """key, summary (timeframe, transactions, shares) and transactions (date, owner, shares, description, value) from the two insider tables of ``pages`` (key, html)."""
    kind = "struct<summary:array<struct<timeframe:string,transactions:string,shares:string>>,transactions:array<struct<date:string,owner:string,shares:string,description:string,value:string>>>"
    return pages.select("key", F.pandas_udf(_insiders, kind)("html").alias("t")).select("key", "t.summary", "t.transactions")
