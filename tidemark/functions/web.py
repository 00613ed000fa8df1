"""Addresses, symbols and pages: canonical URLs, exchange suffixes, links and labelled values in HTML, Form 4 XML, quote frames."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markup
from .names import without_accents
from .numbers import col

#: Parameters that only track. Fixed values.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_eid", "mc_cid"]
#: Suffix of a ticker: market identifier code. Fixed values.
MIC = {".PA": "XPAR", ".AS": "XAMS", ".BR": "XBRU", ".DE": "XETR", ".F": "XFRA", ".L": "XLON", ".MI": "XMIL", ".MC": "XMAD", ".ST": "XSTO", ".HE": "XHEL", ".SW": "XSWX"}
#: Suffix of a ticker: exchange in streamed quotes. Fixed values.
STREAM = {
    ".PA": "EURONEXT", ".AS": "EURONEXT", ".BR": "EURONEXT", ".DE": "XETRA", ".F": "FWB", ".L": "LSE", ".MI": "MIL", ".MC": "BME", ".ST": "OMX", ".OL": "OSL", ".HE": "OMXHEX", ".SW": "SIX",
    ".TO": "TSX", ".AX": "ASX",
}
#: Exchange: suffix of a ticker. Fixed values.
SUFFIX = {
    "PAR": ".PA", "AMS": ".AS", "BRU": ".BR", "LIS": ".LS", "LON": ".L", "FRA": ".F", "GER": ".DE", "XETRA": ".DE", "MAD": ".MC", "MIL": ".MI", "VX": ".SW", "STU": ".SG", "BER": ".BE", "MUN": ".MU",
    "DUS": ".DU", "HAN": ".HA", "BSE": ".BO", "NSE": ".NS", "TSE": ".T", "HKG": ".HK", "SHG": ".SS", "SZE": ".SZ", "ASX": ".AX", "TSX": ".TO", "TSXV": ".V", "NYQ": "", "NMS": "", "NGM": "", "NCM": "",
    "US": "",
}
#: Form 4 transaction code: what it stands for. Fixed values.
FORM4 = {"P": "Buy", "S": "Sell", "A": "Award", "M": "Option Exercise", "G": "Gift", "F": "Tax Withholding", "D": "Sale to Issuer", "I": "Discretionary", "C": "Conversion", "W": "Will/Inheritance", "X": "Option Exercise"}


#: Suffix of a ticker: language of its news. Fixed values.
LANGUAGE = {".PA": "fr", ".AS": "nl", ".BR": "fr", ".DE": "de", ".F": "de", ".L": "en", ".MI": "it", ".MC": "es", ".ST": "sv", ".HE": "fi", ".SW": "de", ".TO": "en"}
#: Suffix of a ticker: country in one service's addresses. Fixed values.
COUNTRY = {".PA": "fr", ".AS": "nl", ".BR": "be", ".DE": "de", ".F": "de", ".L": "uk", ".MI": "it", ".MC": "es", ".ST": "se", ".HE": "fi", ".SW": "ch", ".TO": "ca"}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def canonical_url(url: Column | str) -> Column:
    """Lower case, without fragment, ``;`` parameters, tracking or blank parameters and trailing slashes; equal keys stand together."""
    u = F.substring_index(F.lower(col(url)), "#", 1)
    base = F.regexp_replace(F.regexp_replace(F.substring_index(u, "?", 1), ";[^/]*$", ""), "/+$", "")
    query = F.when(u.contains("?"), F.regexp_replace(u, r"^[^?]*\?", "")).otherwise("")
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.") & ~name(p).isin(TRACKING))
    grouped = F.flatten(F.transform(F.array_distinct(F.transform(kept, name)), lambda k: F.filter(kept, lambda p: name(p) == k)))
    return F.concat(base, F.when(F.size(grouped) > 0, F.concat(F.lit("?"), F.array_join(grouped, "&"))).otherwise(""))


def suffix(ticker: Column | str) -> Column:
    """``.PA`` of ``AIR.PA``; empty where there is none."""
    return F.regexp_extract(F.upper(col(ticker)), r"(\.[A-Z]{1,2})$", 1)


def market_code(ticker: Column | str) -> Column:
    return F.try_element_at(_map(MIC), suffix(ticker))


def news_language(ticker: Column | str) -> Column:
    """Language of a ticker's market, English where its suffix isn't known."""
    return F.coalesce(F.try_element_at(_map(LANGUAGE), suffix(ticker)), F.lit("en"))


def market_country(ticker: Column | str) -> Column:
    """Country of a ticker's market as an address has it; null where its suffix isn't known."""
    return F.try_element_at(_map(COUNTRY), suffix(ticker))


def stream_symbol(ticker: Column | str) -> Column:
    """struct(exchange, symbol): ``AIR.PA`` to EURONEXT and AIR; a ticker without a known suffix is of NASDAQ."""
    t = F.upper(col(ticker))
    exchange = F.try_element_at(_map(STREAM), suffix(t))
    bare = F.regexp_replace(t, r"\.[A-Z]{1,2}$", "")
    return F.struct(F.coalesce(exchange, F.lit("NASDAQ")).alias("exchange"), F.when(exchange.isNull(), t).otherwise(bare).alias("symbol"))


def exchange_symbol(ticker: Column | str, exchange: Column | str) -> Column:
    """A ticker with its exchange's suffix, if it has none yet; null for an unknown exchange."""
    t = F.upper(col(ticker))
    return F.when(t.contains("."), t).otherwise(F.concat(t, F.try_element_at(_map(SUFFIX), F.upper(col(exchange)))))


def slug(text: Column | str) -> Column:
    """Lower case without accents, words joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(without_accents(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def isin_in(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(text), r"\b([A-Z]{2}[A-Z0-9]{9}[0-9])\b", 1), F.lit(""))


def without_footnotes(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\[.*?\]", ""))


class _Page(HTMLParser):
    """Links with their texts and times, and cells in order, of a page."""

    CELLS = {"dt": "label", "th": "label", "dd": "value", "td": "value"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.cells: list[list[str]] = []
        self.open: list[list] = []
        self.link = self.time = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.link = {"url": dict(attrs).get("href") or "", "title": "", "time": None}
            self.links.append(self.link)
        elif tag == "time":
            self.time = dict(attrs).get("datetime") or ""
            if self.links:
                self.links[-1]["time"] = self.time
        elif tag in self.CELLS:
            self.cells.append([self.CELLS[tag], ""])
            self.open.append(self.cells[-1])
        elif tag in ("tr", "dl"):
            self.cells.append(["row", ""])

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        elif tag == "time":
            self.time = None
        elif tag in self.CELLS and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.link is not None:
            self.link["title"] += data
        if self.time == "" and self.links:
            self.links[-1]["time"] = data.strip()
        if self.open:
            self.open[-1][1] += data


def _read(page: str | None) -> _Page:
    p = _Page()
    markup.read(p, page or "")
    return p


def cards_of(page: str | None) -> list[dict]:
    """Links whose text has five characters or more."""
    found = [x | {"title": " ".join(x["title"].split())} for x in _read(page).links]
    return [x for x in found if len(x["title"]) >= 5 and x["url"]]


def labels_of(page: str | None) -> list[dict]:
    """Labels with the value that follows them: dt and dd, th and td, or the first two cells of a row."""
    out, label, first = [], None, True
    for kind, text in _read(page).cells:
        text = " ".join(text.split())
        if kind == "row":
            label, first = None, True
        elif label is None and (kind == "label" or first):
            label, first = text.rstrip(" :"), False
        elif label is not None and kind == "value":
            out.append({"label": label, "value": text})
            label = None
    return [x for x in out if x["label"]]


def cards(html: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(cards_of), "array<struct<title:string,url:string,time:string>>")(col(html))


def label_values(html: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(labels_of), "array<struct<label:string,value:string>>")(col(html))


def form4_of(xml: str | None) -> list[dict]:
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    text = lambda node, path: (node.findtext(path) or "").strip() or None
    number = lambda s: float(s) if s and re.fullmatch(r"-?\d+(\.\d+)?", s) else None
    out = []
    for t in root.iter("nonDerivativeTransaction"):
        shares, price = (number(text(t, f"transactionAmounts/{x}/value")) for x in ("transactionShares", "transactionPricePerShare"))
        code = text(t, "transactionCoding/transactionCode") or "S"
        out.append(
            {
                "owner": text(root, "reportingOwner/reportingOwnerId/rptOwnerName"), "title": text(root, "reportingOwner/reportingOwnerRelationship/officerTitle"), "date": text(t, "transactionDate/value"),
                "code": code, "type": FORM4.get(code, code), "shares": shares, "price": price, "total": None if shares is None or price is None else shares * price,
                "owned_after": number(text(t, "postTransactionAmounts/sharesOwnedFollowingTransaction/value")),
            }
        )
    return out


def form4(xml: Column | str) -> Column:
    kind = "array<struct<owner:string,title:string,date:string,code:string,type:string,shares:double,price:double,total:double,owned_after:double>>"
    return F.pandas_udf(lambda s: pd.Series([form4_of(x) for x in s]), kind)(col(xml))


def quote_frames(messages: DataFrame, column: str = "message") -> DataFrame:
    """ts, open, high, low, close, volume of the bars in framed quote messages; what isn't a whole bar is left out."""
    parts = messages.select(F.explode(F.split(column, r"~m~\d+~m~")).alias("part")).where(F.col("part").contains("timescale_update"))
    bars = F.from_json(F.get_json_object("part", "$.p[1].sds_1.s"), "array<struct<v:array<double>>>")
    v = parts.select(F.explode(bars).alias("b")).select(F.col("b.v").alias("v")).where("size(v) >= 5")
    names = ["open", "high", "low", "close"]
    out = v.select(F.timestamp_seconds(F.get("v", 0)).alias("ts"), *(F.get("v", i + 1).alias(n) for i, n in enumerate(names)), F.coalesce(F.get("v", 5), F.lit(0.0)).cast("bigint").alias("volume"))
    return out.where("ts is not null and open is not null and high is not null and low is not null and close is not null")
