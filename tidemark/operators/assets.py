"""Assets with everything about them: context, mappings, candidates for enrichment, compatibility, addresses, latest figures, ingests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import falsy
from tidemark.functions.web import suffix

from .bars import first_source, gap_ranges, history_range, normalise, ranked, upsert
from .identity import ISIN_SHAPE, PRIMARY_CURRENCIES

#: Exchange: its code in quote addresses of one service. Fixed values.
QUOTE_CODES = {"XPAR": "EPA", "XAMS": "AMS", "XBRU": "EBR", "XETR": "ETR", "XLON": "LON", "XMIL": "BIT", "XMAD": "BME", "XSTO": "STO", "XHEL": "HEL", "XSWX": "SWX", "NYSE": "NYSE", "NASDAQ": "NASDAQ"}
EUROPEAN = [".PA", ".AS", ".BR", ".DE", ".F", ".L", ".MI", ".MC", ".ST", ".HE", ".SW"]


def latest_by(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key; the larger ``tie`` wins equal times."""
    return ranked(rows, keys, [F.desc(time), F.desc(tie)])


def mappings_in_force(mappings: DataFrame) -> DataFrame:
    """Of active ``mappings`` (mapping_id, asset_id, listing_id: null for the whole asset, provider, value, is_active) one for each asset and provider: that of a listing goes before that of the asset, the later before the earlier."""
    specific = F.col("listing_id").isNotNull().cast("int")
    return ranked(mappings.where("is_active"), ["asset_id", "provider"], [specific.desc(), F.desc("mapping_id")])


def context(assets: DataFrame, listings: DataFrame, mappings: DataFrame) -> DataFrame:
    """``assets`` with their listings (an array in order of id) and the mappings in force (a map from provider to value)."""
    l = listings.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("listing_id", "ticker", "exchange", "currency"))).alias("listings"))
    m = mappings_in_force(mappings).groupBy("asset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "value")))).alias("mappings"))
    return assets.join(l, "asset_id", "left").join(m, "asset_id", "left")


def candidates(rows: DataFrame, most: int = 5) -> DataFrame:
    """asset_id, place, term: the first ``most`` different terms of ``rows`` (asset_id, terms: array in order) that are neither empty nor an ISIN."""
    each = rows.select("asset_id", F.posexplode("terms").alias("p", "term")).withColumn("term", F.upper(F.trim("term")))
    usable = each.where((F.col("term") != "") & ~F.col("term").rlike(ISIN_SHAPE))
    first = usable.groupBy("asset_id", "term").agg(F.min("p").alias("p"))
    w = Window.partitionBy("asset_id").orderBy("p")
    return first.select("asset_id", F.row_number().over(w).alias("place"), "term").where(F.col("place") <= most)


def compatible(known_isin: Column, new_isin: Column, known_kind: Column, new_kind: Column) -> Column:
    """Metadata fits an asset: equal ISINs where both are known, and no stock for a fund or the other way round."""
    isins = F.coalesce(F.nullif(known_isin, F.lit("")) == F.nullif(new_isin, F.lit("")), F.lit(True))
    a, b = F.lower(known_kind), F.lower(new_kind)
    return isins & ~F.coalesce(((a == "stock") & (b == "etf")) | ((a == "etf") & (b == "stock")), F.lit(False))


def quote_address(ticker: Column, exchange: Column) -> Column:
    """Address of a quote page; null for an unknown exchange."""
    code = F.try_element_at(F.create_map(*(F.lit(x) for pair in QUOTE_CODES.items() for x in pair)), exchange)
    return F.concat(F.lit("https://www.google.com/finance/quote/"), F.substring_index(ticker, ".", 1), F.lit(":"), code)


def yahoo_address(ticker: Column, currency: Column) -> Column:
    """Address of a page on another service; null where a ticker without suffix could be of several euro exchanges."""
    known = ticker.contains(".") | currency.isin(PRIMARY_CURRENCIES)
    return F.when(known, F.concat(F.lit("https://finance.yahoo.com/quote/"), ticker))


def compatible_provider(provider: Column, ticker: Column, european: list[str]) -> Column:
    """False where a provider knows only European instruments and the ticker is none."""
    return ~(provider.isin(european) & ~suffix(ticker).isin(EUROPEAN))


def mentioned(mappings: DataFrame, ticker: str) -> DataFrame:
    """``mappings`` whose value holds the ticker behind a slash. As in an unanchored LIKE, ``/A`` is also found in ``/AAPL``."""
    return mappings.where(F.col("value").contains(f"/{ticker}"))


def recent_closes(bars: DataFrame, listings: DataFrame, since: str) -> DataFrame:
    """ticker, ts, close of daily bars since a day."""
    days = bars.where((F.col("resolution") == "1D") & (F.col("ts") >= since))
    return days.join(listings.select("asset", "ticker"), "asset").select("ticker", "ts", "close")


def estimates(eps: DataFrame, revenue: DataFrame) -> DataFrame:
    """asset_id, period, eps and revenue estimates of the periods that both have."""
    return eps.join(revenue, ["asset_id", "period"])


def highlights_with_fallback(current: DataFrame, legacy: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``current`` by asset_id; where they are null or 0 those of ``legacy`` count."""
    old = legacy.select("asset_id", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = current.join(old, "asset_id", "full")
    return joined.select("asset_id", *(falsy(F.col(c), F.col(f"_{c}")).alias(c) for c in columns))


def resolve_alert(alerts: DataFrame, alert_ids: list[int], at: str) -> DataFrame:
    """``alerts`` (alert_id, resolved_at, ...) with some resolved; those that were already keep their time."""
    chosen = F.col("alert_id").isin(alert_ids)
    return alerts.withColumn("resolved_at", F.when(chosen, F.coalesce("resolved_at", F.lit(at).cast("timestamp_ntz"))).otherwise(F.col("resolved_at")))


def rolling_rates(daily: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """provider, rate over the last ``days``, rate_30d, and how many alerts could stand: one aggregation with filters."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("date"))
    return daily.where(age.between(0, 29)).groupBy("provider").agg(F.avg(F.when(age < days, F.col("success_rate"))).alias("rate"), F.avg("success_rate").alias("rate_30d"))


def with_open_alerts(providers: DataFrame, alerts: DataFrame) -> DataFrame:
    """``providers`` with open_alerts: one join on counts, not a query for each provider."""
    n = alerts.where("resolved is null").groupBy("provider").agg(F.count(F.lit(1)).alias("open_alerts"))
    return providers.join(n, "provider", "left").withColumn("open_alerts", F.coalesce("open_alerts", F.lit(0)))


def ingest(stored: DataFrame, primary: DataFrame, secondary: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Bars after an ingest, and its log (asset, status, n): what is due by ``gap_ranges`` is taken from the first source that has an asset, normalised and upserted.

    Bars have asset, ts, open, high, low, close, volume; those of the sources an ordinal too.
    """
    known = history_range(stored)
    every = primary.select("asset").union(secondary.select("asset")).distinct()
    due = gap_ranges(every.join(known, "asset", "left"), today)
    fetched = first_source(primary, secondary, keys=["asset"])
    day = F.to_date("ts")
    clean = normalise(fetched.join(due.where(~F.col("up_to_date")), "asset").where(day.between(F.col("fetch_from"), F.col("fetch_to"))).select(*fetched.columns))
    new = clean.select(*stored.columns)
    got = new.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    log = due.join(got, "asset", "left").select("asset", F.when(F.col("up_to_date"), "up_to_date").when(F.col("n") > 0, "success").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
    return upsert(stored, new, ["asset", "ts"], time="ts"), log
