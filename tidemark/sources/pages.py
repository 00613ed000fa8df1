"""Company figures from provider pages and feeds that have been fetched: a row for each page in, a row for each page out.

Fetching is left to whoever has a network; each provider is a table of labels here, so that a new one needs no code.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, web

FIELDS = ["revenue", "net_income", "operating_income", "eps", "pe_ratio", "dividend_yield", "ebitda", "operating_margin", "profit_margin"]
_FRENCH = [
    ("chiffre d'affaires", "revenue"), ("net sales", "revenue"), ("résultat net", "net_income"), ("net income", "net_income"), ("bna", "eps"), ("bpa", "eps"), ("eps", "eps"), ("per", "pe_ratio"), ("p/e", "pe_ratio"),
    ("rendement", "dividend_yield"), ("yield", "dividend_yield"), ("ebitda", "ebitda"), ("marge d'exploitation", "operating_margin"), ("operating margin", "operating_margin"), ("marge nette", "profit_margin"),
    ("net margin", "profit_margin"),
]
_SHORT = [("p/e", "pe_ratio"), ("yield", "dividend_yield"), ("eps", "eps")]
#: Provider: how its numbers are written, and (part of a label in lower case, field) in order of precedence.
PROVIDERS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "zonebourse": ("french", _FRENCH),
    "boursorama": ("french", _FRENCH),
    "boursedirect": ("french", _FRENCH),
    "investir": ("french", _FRENCH),
    "fortuneo": ("french", _FRENCH),
    "googlefinance": (
        "magnitude",
        [("revenue", "revenue"), ("net income", "net_income"), ("operating income", "operating_income"), ("operating margin", "operating_margin"), ("net profit margin", "profit_margin"), ("earnings per share", "eps"), ("ebitda", "ebitda"), ("p/e ratio", "pe_ratio"), ("dividend yield", "dividend_yield")],
    ),
    "barrons": ("plain", _SHORT),
    "wallstreetjournal": ("plain", _SHORT),
    "marketwatch": ("plain", _SHORT),
    "morningstar": ("plain", [("price/earnings", "pe_ratio"), *_SHORT]),
    "investing": ("plain", _SHORT),
}


_NUMBERS = {"french": numbers.french_number, "magnitude": numbers.magnitude, "plain": numbers.first_number}


def _case(ways: Iterable[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda made, way: made.when(*way), ways, F)


def page_metrics(pages: DataFrame) -> DataFrame:
    """key, provider and FIELDS from ``pages`` (key, provider, html). The first label that names a field and has a number counts."""
    provider = F.col("provider")
    alike: dict[tuple[str, tuple], list[str]] = {}
    for name, (kind, rules) in PROVIDERS.items():
        alike.setdefault((kind, tuple(rules)), []).append(name)

    def cell(c: Column) -> Column:
        label = F.lower(c["label"])
        return F.struct(_case((provider.isin(names), _case((label.contains(needle), F.lit(field)) for needle, field in rules)) for (_, rules), names in alike.items()).alias("field"), c["value"].alias("text"))

    def number(text: Column) -> Column:
        written = {kind: [name for (k, _), names in alike.items() if k == kind for name in names] for kind, _ in alike}
        return _case((provider.isin(names), _NUMBERS[kind](text)) for kind, names in written.items())

    named = pages.select("key", "provider", F.filter(F.transform(web.label_values("html"), cell), lambda c: c["field"].isNotNull()).alias("cells"))
    told = named.select("key", "provider", F.filter(F.transform("cells", lambda c: F.struct(c["field"].alias("field"), number(c["text"]).alias("value"))), lambda c: c["value"].isNotNull()).alias("cells"))
    return told.select("key", "provider", *(F.get(F.filter("cells", lambda c: c["field"] == f), F.lit(0))["value"].alias(f) for f in FIELDS))


class _Tables(HTMLParser):
    def __init__(self, table_id: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.table_id, self.tables, self.row, self.cell, self.depth = table_id, [], None, None, 0
        self.best: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
                if (self.table_id and a.get("id") == self.table_id) or (self.best is None and not self.table_id and "wikitable" in (a.get("class") or "")):
                    self.best = self.tables[-1]
        elif tag == "tr" and self.depth == 1:
            self.row = []
            self.tables[-1].append(self.row)
        elif tag in ("td", "th") and self.row is not None and self.depth == 1:
            self.cell = [""]
            self.row.append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.depth = max(0, self.depth - 1)
            self.row = self.cell = None
        elif tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data


def rows_of(page: str | None, table_id: str | None = None) -> list[dict[str, str]]:
    """Rows of the table with an id, or of the first wikitable, by its headers; footnote marks go, as do rows without text."""
    p = _Tables(table_id)
    p.feed(page or "")
    p.close()
    rows = [[" ".join(_bare(c[0]).split()) for c in r] for r in p.best or []]
    if not rows:
        return []
    return [dict(zip(rows[0], r, strict=False)) for r in rows[1:] if any(r)]


def _bare(text: str) -> str:
    out, depth = [], 0
    for c in text:
        depth += c == "["
        if not depth:
            out.append(c)
        depth -= c == "]" and depth > 0
    return "".join(out)


def index_members(pages: DataFrame, table_id: str | None = None) -> DataFrame:
    """index_name, ticker, name, sector from ``pages`` (index_name, html); headers go by several names."""
    rows = F.pandas_udf(lambda s: s.map(lambda x: rows_of(x, table_id)), "array<map<string,string>>")("html")
    r = pages.select("index_name", F.explode(rows).alias("r"))
    pick = lambda *names: numbers.first_present(*(F.try_element_at("r", F.lit(n)) for n in names))
    out = r.select("index_name", F.upper(pick("Symbol", "Ticker", "Ticker symbol")).alias("ticker"), pick("Security", "Company", "Name").alias("name"), pick("GICS Sector", "Sector", "ICB Sector", "Prime Standard Sector").alias("sector"))
    return out.where("ticker is not null")


def insider_filings(submissions: DataFrame, most: int = 15) -> DataFrame:
    """cik, filed, accession of the newest Form 4 filings in submission documents (cik, json), ``most`` of each."""
    j = F.from_json("json", "filings struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>>>")
    r = submissions.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), j["filings"]["recent"].alias("r"))
    rows = r.select("cik", F.explode(F.arrays_zip("r.form", "r.filingDate", "r.accessionNumber")).alias("f")).where("f.form = '4'")
    from tidemark.operators.bars import ranked

    return ranked(rows.select("cik", F.col("f.filingDate").try_cast("date").alias("filed"), F.col("f.accessionNumber").alias("accession")), ["cik"], [F.desc("filed"), F.col("accession")], most)


def identifier_mappings(batches: DataFrame) -> DataFrame:
    """isin, figi, ticker, exchange from ``batches`` (isins: array, json: an array of results in the same order); errors have no rows."""
    j = F.from_json("json", "array<struct<data:array<struct<figi:string,ticker:string,exchCode:string>>,error:string>>")
    each = batches.select("isins", F.posexplode(j).alias("place", "result"))
    return each.select(F.get("isins", F.col("place")).alias("isin"), F.explode("result.data").alias("d")).select("isin", "d.figi", "d.ticker", F.col("d.exchCode").alias("exchange"))


_ARTICLE = "struct<title:string,headline:string,url:string,link:string,webUrl:string,publishedDateTime:string,datePublished:string,providerPublishTime:bigint,provider:string,source:string,publisher:string,imageUrl:string,image:string,thumbnail:string>"


def _image(c: str) -> Column:
    """Address of an article's image: a text, or an object with url or imageUrl, or one of a list of resolutions, of which the first counts."""
    told = numbers.first_present(*(f"{c}.{k}" for k in ("imageUrl", "image", "thumbnail")))
    inside = F.coalesce(*(F.nullif(F.get_json_object(told, k), F.lit("")) for k in ("$.url", "$.imageUrl", "$.resolutions[0].url")))
    return F.when(told.startswith("{"), inside).when(~told.startswith("["), told)


def feed_articles(feeds: DataFrame, provider: str, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns, title, url, source, published_at, language, provider, image from feed documents (json); keys go by several names, articles without title or address are left out."""
    j = F.from_json("json", ", ".join(f"{k} array<{_ARTICLE}>" for k in ("subCards", "value", "items", "news")))
    c = feeds.select(*keep, F.explode(F.coalesce(j["subCards"], j["value"], j["items"], j["news"])).alias("c"))
    at = F.coalesce(F.try_to_timestamp(F.coalesce("c.publishedDateTime", "c.datePublished")), dates.epoch_time("c.providerPublishTime"))
    out = c.select(*keep, numbers.first_present("c.title", "c.headline").alias("title"), numbers.first_present("c.url", "c.link", "c.webUrl").alias("url"), numbers.first_present("c.provider", "c.source", "c.publisher").alias("source"), at.alias("published_at"), F.lit("en").alias("language"), F.lit(provider).alias("provider"), _image("c").alias("image"))
    return out.where("title is not null and url is not null")


def fund_profile(documents: DataFrame) -> DataFrame:
    """key, ter, size, currency, and holdings (name, weight) from fund documents (key, json)."""
    j = F.from_json("json", "ter string, fundSize string, currency string, holdings array<struct<name:string,percentage:string>>")
    d = documents.select("key", j.alias("d"))
    holdings = F.transform("d.holdings", lambda h: F.struct(h["name"].alias("name"), numbers.percent_ratio(h["percentage"]).alias("weight")))
    return d.select("key", numbers.percent_ratio("d.ter").alias("ter"), numbers.currency_amount("d.fundSize").alias("size"), F.col("d.currency").alias("currency"), holdings.alias("holdings"))


def wrapped_hits(answers: DataFrame) -> DataFrame:
    """query, id, slug from search answers (query, json) whose first hit is a JSON text within the JSON, or an object."""
    a = answers.select("query", F.get_json_object("json", "$.data.stocks[0]").alias("hit"))
    key = lambda name: F.coalesce(F.get_json_object("hit", f"$.{name}"), F.lit(""))
    symbol, country = F.lower(key("OS001Index")), F.lower(key("RT0EC"))
    named = F.when((symbol != "") & (country != ""), F.concat_ws("-", symbol, country)).otherwise(F.lower("query"))
    return a.select("query", numbers.first_present(key("SecId"), key("SecID")).alias("id"), F.concat(named, F.lit("-stock")).alias("slug")).where("id is not null")


def kept_fetches(fetches: DataFrame, limit: int) -> DataFrame:
    """The ``fetches`` (company, place, filed, accession, ok, n) of filings that are read for ``limit`` transactions, in order of place, with before: the transactions of those that come earlier.

    Of a company the first 15 filings, or twice the limit if that is less, are looked at; those without a date or number are passed over. Reading stops
    when there are transactions enough, or after three failures (ok is false) in a row. A failed fetch has no transactions.
    """
    order = Window.partitionBy("company").orderBy("place")
    looked_at = fetches.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= min(2 * limit, 15))
    tried = looked_at.where("filed is not null and accession is not null").withColumns({"ok": F.coalesce("ok", F.lit(False)), "n": F.when(F.coalesce("ok", F.lit(False)), F.coalesce("n", F.lit(0))).otherwise(0)})
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = tried.withColumn("_run", F.count_if("ok").over(up_to))  # a success begins a run
    failed = runs.withColumn("_failures", F.count_if(~F.col("ok")).over(Window.partitionBy("company", "_run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    told = failed.withColumns({"_stop": F.coalesce(F.max(F.col("_failures") >= 3).over(before), F.lit(False)), "before": F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint")})
    return told.where(~F.col("_stop") & (F.col("before") < limit)).drop("_nth", "_run", "_failures", "_stop")


def bars_to_ask(days: Column, resolution: str) -> Column:
    """How many bars a service is asked for to cover ``days``: at least 10 days, or 5 weeks or months, and a margin."""
    week, month = F.floor(days / 7) + 5, F.floor(days / 30) + 5
    return {"1D": F.greatest(F.lit(10), days), "1W": F.greatest(F.lit(5), week), "1M": F.greatest(F.lit(5), month)}[resolution].cast("bigint")
