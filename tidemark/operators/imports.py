"""What an import adds beside assets: new listings with their exchange and primary flag, and their addresses at providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.web import market_code

from .assets import quote_address, yahoo_address
from .identity import primary_flags


def new_listings(known: DataFrame, rows: DataFrame) -> DataFrame:
    """isin, ticker, exchange, currency, ordinal, is_primary of the listings that valid ``rows`` (ordinal, isin, ticker, currency) add to ``known`` ones (isin, ticker, exchange, currency, is_primary).

    The exchange is that of the ticker's suffix, or empty. A known listing with a null exchange or currency is met by a row with the same.
    """
    exchange = F.coalesce(market_code("ticker"), F.lit(""))
    asked = rows.withColumn("exchange", exchange).groupBy("isin", "ticker", "exchange", "currency").agg(F.min("ordinal").alias("ordinal"))
    stored = known.select(*(F.col(c).alias(f"_{c}") for c in ("isin", "ticker", "exchange", "currency")))
    same = (F.col("isin") == F.col("_isin")) & (F.col("ticker") == F.col("_ticker")) & F.col("exchange").eqNullSafe(F.col("_exchange")) & F.col("currency").eqNullSafe(F.col("_currency"))
    new = asked.join(stored, same, "left_anti")
    before = known.join(new.select("isin").distinct(), "isin", "left_semi").select("isin", "ticker", "exchange", "currency", F.lit(-1).cast("long").alias("ordinal"), F.coalesce("is_primary", F.lit(False)).alias("was_primary"))
    flagged = primary_flags(before.unionByName(new.withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("was_primary", F.lit(None).cast("boolean"))))
    return flagged.where("was_primary is null").drop("was_primary")


def default_mappings(listings: DataFrame, mappings: DataFrame) -> DataFrame:
    """The addresses at two services that new ``listings`` (isin, ticker, exchange, currency) get, but those that ``mappings`` (isin, ticker, exchange, currency, provider_name) have already.

    isin, ticker, exchange, currency, provider_name, provider_ticker, provider_url, source, confidence_score. A listing whose address isn't known has no row.
    """
    ways = F.array(
        F.struct(F.lit("YahooFinance").alias("name"), yahoo_address(F.col("ticker"), F.col("currency")).alias("url")),
        F.struct(F.lit("GoogleFinance").alias("name"), quote_address(F.col("ticker"), F.col("exchange")).alias("url")),
    )
    key = ["isin", "ticker", "exchange", "currency"]
    made = listings.select(*key, F.explode(F.filter(ways, lambda x: x["url"].isNotNull())).alias("m")).select(*key, F.col("m.name").alias("provider_name"), F.col("ticker").alias("provider_ticker"), F.col("m.url").alias("provider_url"))
    there = mappings.select(*(F.col(c).alias(f"_{c}") for c in (*key, "provider_name")))
    same = (F.col("isin") == F.col("_isin")) & (F.col("provider_name") == F.col("_provider_name"))
    for c in key[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return made.join(there, same, "left_anti").withColumns({"source": F.lit("csv_import"), "confidence_score": F.lit(1.0)})
