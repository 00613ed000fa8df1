"""The best hit of a symbol search, the term to search a provider for, and records as an end-of-day service gives them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import first_present
from tidemark.functions.web import exchange_symbol

from .bars import ranked

#: Period: days before today. Fixed values.
DAYS = {"1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730, "5y": 1825, "10y": 3650, "max": 7300, "daily": 365, "weekly": 365, "monthly": 730}
MARKETS = ["XPAR", "XAMS", "XBRU", "XLIS", "XETR", "XNAS", "XNYS"]


def _last(c: Column) -> Column:
    """Rows for which ``c`` holds come after the others; unknown counts as true."""
    return F.coalesce(c, F.lit(True)).cast("int").asc()


def quote_order() -> list[Column]:
    """Hits (query, symbol, kind, own, score): own pages, the very symbol, known kinds, the best score."""
    kinds = ["EQUITY", "ETF", "MUTUALFUND", "INDEX"]
    return [_last(~F.coalesce("own", F.lit(True))), _last(F.upper("symbol") != F.upper(F.trim("query"))), _last(~F.upper("kind").isin(kinds)), F.desc(F.coalesce("score", F.lit(0.0))), F.col("symbol")]


def symbol_order() -> list[Column]:
    """Hits (query, symbol as ``EXCHANGE:TICKER``, country, kind, score): the very ticker, of the US, stocks, the best score."""
    q, s = F.upper(F.trim("query")), F.upper("symbol")
    return [_last((F.substring_index(s, ":", -1) != q) & (s != q)), _last(F.upper("country") != "US"), _last(F.lower("kind") != "stock"), F.desc(F.coalesce("score", F.lit(0.0))), F.col("symbol")]


def item_order() -> list[Column]:
    """Hits (query, isin, symbol, price, currency, kind): the very ISIN or, if the query is none, the very symbol; priced, with a currency, shares."""
    q = F.upper(F.trim("query"))
    is_isin = q.rlike("^[A-Z]{2}[A-Z0-9]{10}$")
    return [_last(is_isin & (F.upper("isin") != q)), _last(~is_isin & (F.upper("symbol") != q)), _last(F.col("price").isNull()), _last(F.col("currency").isNull()), _last(F.lower("kind") != "action"), F.col("symbol"), F.col("isin")]


def market_order(markets: list[str] = MARKETS) -> list[Column]:
    """Hits (query, isin, symbol, market): the very symbol or ISIN, then the markets in their order."""
    q = F.upper(F.trim("query"))
    place = F.array_position(F.array(*map(F.lit, markets)), F.upper("market"))
    return [_last((F.upper("symbol") != q) & (F.upper("isin") != q)), F.when(place > 0, place).otherwise(len(markets) + 1).asc(), F.upper("symbol"), F.col("market"), F.col("isin")]


def best(hits: DataFrame, order: list[Column], place: str | None = None) -> DataFrame:
    """The first hit of each request. Those that ``order`` leaves equal go by their ``place`` in the provider's list, if there is one, then by their columns in turn, so that reruns agree."""
    return ranked(hits, ["request_id"], [*order, *([] if place is None else [place]), *hits.columns])


def search_term(rows: DataFrame) -> DataFrame:
    """``rows`` (ticker, isin, default_ticker, mapped_url, mapped_ticker, official_symbol, exchange) with term and how it was found."""
    made = exchange_symbol(F.coalesce("official_symbol", "ticker"), "exchange")
    ways = [("url", F.col("mapped_url")), ("mapped", F.col("mapped_ticker")), ("default", F.col("default_ticker")), ("made", made), ("ticker", F.col("ticker")), ("isin", F.col("isin"))]
    how = F.coalesce(*(F.when(F.nullif(c, F.lit("")).isNotNull(), n) for n, c in ways))
    return rows.withColumns({"term": first_present(*(c for _, c in ways)), "how": how})


def period_bounds(period: str, as_of: str) -> tuple[Column, Column]:
    """First and last day of a period that ends at ``as_of``."""
    day = F.lit(as_of).cast("date")
    return (F.trunc(day, "year") if period == "ytd" else F.date_sub(day, DAYS.get(period, 365))), day


def checked_ticker(ticker: str) -> str:
    """``ticker``, or ValueError if it's too long or has other characters than letters, digits, ``-`` and ``.``."""
    if not ticker or len(ticker) > 10 or not ticker.replace("-", "").replace(".", "").isalnum():
        raise ValueError(f"no ticker: {ticker!r}")
    return ticker


def checked_request(ticker: str, order: str = "a", start: str | None = None, end: str | None = None) -> tuple[str, bool, str | None, str | None]:
    """ticker, ascending, start and end of a request for records, or ValueError: the order is a or d, and start isn't after end (ISO dates)."""
    if order not in ("a", "d"):
        raise ValueError(f"no order: {order!r}")
    days = [None if d is None else datetime.date.fromisoformat(d) for d in (start, end)]
    if None not in days and days[0] > days[1]:
        raise ValueError(f"{start} is after {end}")
    return checked_ticker(ticker), order == "a", start, end


def eod_records(bars: DataFrame) -> DataFrame:
    """Date as month-day-year; missing prices are 0, a missing adjusted close is the close."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    close = zero("close")
    return bars.select("asset", F.date_format("ts", "MM-dd-yyyy").alias("date"), zero("open").alias("open"), zero("high").alias("high"), zero("low").alias("low"), close.alias("close"), F.coalesce(F.col("adj_close"), close).alias("adj_close"), F.coalesce("volume", F.lit(0)).alias("volume"))


def write_records(records: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes records as CSV with a header, or as lines of JSON."""
    w = records.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


def exchange_by_part(names: DataFrame, exchanges: DataFrame) -> DataFrame:
    """``names`` (name, ...) with the suffix of the first of ``exchanges`` (place, name, country, suffix) whose name or country holds the name, whatever the case; null where none does.

    Every part of an exchange's name or country is a key that tells the first exchange it belongs to, so finding a name in all of them is one equi-join. There are
    as many keys as the square of a name's length; an empty name is part of all. Repeated rows stay.
    """
    texts = exchanges.select("place", "suffix", F.explode(F.array_distinct(F.array(F.upper(F.coalesce("name", F.lit(""))), F.upper(F.coalesce("country", F.lit("")))))).alias("t"))
    starts = texts.select("place", "suffix", "t", F.explode(F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1)))).alias("i"))
    parts = starts.select("place", "suffix", F.explode(F.sequence(F.lit(0), F.length("t") - F.col("i") + 1)).alias("n"), "t", "i").select("place", "suffix", F.substring("t", F.col("i"), F.col("n")).alias("_part"))
    first = parts.groupBy("_part").agg(F.min_by(F.struct("suffix"), "place").alias("_found"))
    return names.join(first, F.upper("name") == F.col("_part"), "left").withColumn("suffix", F.col("_found.suffix")).drop("_part", "_found")


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars partitioned by month and sorted by asset within files, so that a read of a range or an asset skips the rest."""
    placed = bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
    placed.repartitionByRange("month", "asset").sortWithinPartitions("month", "asset", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
