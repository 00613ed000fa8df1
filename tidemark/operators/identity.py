"""Instruments and their listings: validated imports, primary flags, identity, duplicates and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import ranked

PRIMARY_CURRENCIES = ["USD", "GBP", "JPY", "CHF", "CAD", "AUD"]
ISIN_SHAPE = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"


def checked_import(rows: DataFrame) -> DataFrame:
    """``rows`` (ordinal, name, ticker, isin, type, currency) trimmed, with errors (names of faulty fields) and is_duplicate.

    The first valid row of an (isin, currency) is kept, later ones are duplicates.
    """
    clean = rows.select("ordinal", F.trim("name").alias("name"), *(F.upper(F.trim(c)).alias(c) for c in ("ticker", "isin", "type", "currency")))
    rules = [
        ("name", F.col("name") != ""), ("ticker", F.length("ticker").between(1, 20)), ("isin", F.col("isin").rlike("^[A-Z]{2}[A-Z0-9]{10}$")), ("type", F.col("type").isin("STOCK", "ETF")),
        ("currency", F.col("currency").rlike("^[A-Z]{3}$")),
    ]
    errors = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules)), lambda x: x.isNotNull())
    out = clean.withColumn("errors", errors)
    valid = F.size("errors") == 0
    w = Window.partitionBy(F.when(valid, F.col("isin")), F.when(valid, F.col("currency")), F.when(~valid, F.col("ordinal"))).orderBy("ordinal")  # faulty rows, of which there may be many without an ISIN, are each alone
    return out.withColumn("is_duplicate", valid & (F.row_number().over(w) > 1))


def primary_flags(listings: DataFrame) -> DataFrame:
    """``listings`` (isin, ordinal, currency, was_primary: null if new) with is_primary.

    The first listing of an ISIN is primary; where there are some without a primary one, the first new one of a main currency becomes it.
    """
    group = Window.partitionBy("isin")
    first = F.row_number().over(Window.partitionBy("isin").orderBy("ordinal")) == 1
    new = F.col("was_primary").isNull()
    any_primary = F.max(F.coalesce("was_primary", F.lit(False))).over(group)
    old = F.count_if(~new).over(group) > 0
    candidate = new & F.col("currency").isin(PRIMARY_CURRENCIES)
    first_candidate = F.min(F.when(candidate, F.col("ordinal"))).over(group)
    flag = F.when(~new, F.col("was_primary")).when(any_primary, F.lit(False)).when(old, F.coalesce(F.col("ordinal") == first_candidate, F.lit(False))).otherwise(first)
    return listings.withColumn("is_primary", flag)


def _false_first(c: Column) -> Column:
    return F.coalesce(c, F.lit(True)).cast("int")


def identity_order() -> list[Column]:
    """Stocks before funds, dollars first, imports first, primary first, then by name."""
    kind = F.when(F.col("type") == "stock", 0).when(F.col("type") == "etf", 1).otherwise(2)
    return [kind, _false_first(F.col("currency") != "USD"), _false_first(F.col("source") != "import"), _false_first(~F.col("is_primary")), F.col("ticker"), F.col("currency"), F.col("exchange")]


def enrichment_order() -> list[Column]:
    return [_false_first(F.col("currency") != "USD"), _false_first(F.col("source") != "import"), _false_first(~F.col("is_primary")), F.col("ticker"), F.col("listing_id")]


def by_identity(listings: DataFrame, key: str = "ticker") -> DataFrame:
    """The listing that each ``key`` stands for."""
    return ranked(listings, [key], identity_order())


def preferred(listings: DataFrame) -> DataFrame:
    """An asset's listing for enrichment: of the active ones (else all) that of the official symbol, else the primary one, else the first by name."""
    w = Window.partitionBy("asset_id")
    usable = listings.withColumn("_any", F.max(F.col("active").cast("int")).over(w)).where((F.col("_any") == 0) | F.col("active")).drop("_any")
    official = F.coalesce(F.col("ticker") == F.col("official_symbol"), F.lit(False))
    rank = F.when(official, 0).when(F.col("is_primary"), 1).otherwise(2)
    by_rule = [F.when(official, x) for x in (F.col("currency") != "USD", F.col("source") != "import", ~F.col("is_primary"))]
    return ranked(usable, ["asset_id"], [rank.asc(), *(x.cast("int").asc() for x in by_rule), F.col("ticker"), F.col("currency"), F.col("exchange"), F.col("listing_id")])


def duplicate_groups(assets: DataFrame) -> DataFrame:
    """isin, canonical, ids, n of each ISIN with several assets (asset_id, isin)."""
    g = assets.where(F.col("isin").isNotNull()).groupBy("isin").agg(F.min("asset_id").alias("canonical"), F.array_sort(F.collect_list("asset_id")).alias("ids"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1")


def canonical_ids(assets: DataFrame) -> DataFrame:
    """asset_id, canonical: the smallest asset_id of the same ISIN; assets without one stand for themselves."""
    least = F.min("asset_id").over(Window.partitionBy("isin"))
    return assets.where("isin is not null").select("asset_id", least.alias("canonical")).union(assets.where("isin is null").select("asset_id", F.col("asset_id").alias("canonical")))


def repaired(assets: DataFrame, children: DataFrame, keys: list[str], id_column: str = "listing_id") -> tuple[DataFrame, DataFrame]:
    """Assets without duplicates, and ``children`` moved to the asset that stays; of children that then agree in ``keys`` the smallest id stays."""
    ids = canonical_ids(assets)
    moved = children.join(ids, "asset_id", "left").withColumn("asset_id", F.coalesce("canonical", "asset_id")).drop("canonical")
    return assets.join(ids.where("asset_id = canonical"), "asset_id", "left_semi"), ranked(moved, keys, [F.col(id_column)])


def resolved(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """``requests`` (request_id, isin, ticker, exchange) with the asset_id found: by ISIN, else ticker and exchange, else ticker; null if none.

    The first way that finds something counts, then identity_order. Of the listings of a key (an ISIN, say) one goes before all others whatever the request,
    so a request meets that one only: a row for each request and way, however many listings a key has.
    """
    order = F.struct(*identity_order(), F.col("listing_id"))
    l = listings.select("isin", "ticker", "exchange", F.struct(order.alias("order"), "asset_id").alias("l"))
    ways = []
    for way, keys in enumerate((["isin"], ["ticker", "exchange"], ["ticker"]), 1):
        first = l.groupBy(*keys).agg(F.min("l").alias("l"))
        ways.append(requests.select("request_id", *keys).join(first, keys).select("request_id", F.struct(F.lit(way).alias("way"), "l").alias("found")))
    best = ways[0].union(ways[1]).union(ways[2]).groupBy("request_id").agg(F.min("found").alias("found"))
    return requests.join(best.select("request_id", "found.l.asset_id", "found.way"), "request_id", "left")


def filled(known: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``known`` with null or empty ``columns`` taken from ``new``."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = known.join(n, key, "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def listing_search(listings: DataFrame, ticker: str | None = None, exchange: str | None = None, currency: str | None = None, n: int = 50) -> DataFrame:
    """The first ``n`` listings that match what is given: primary ones first, then by ticker, currency, exchange and id."""
    out = listings
    for name, value in (("ticker", ticker), ("exchange", exchange), ("currency", currency)):
        if value is not None:
            out = out.where(F.upper(name) == value.strip().upper())
    return out.orderBy(F.desc("is_primary"), "ticker", "currency", "exchange", "listing_id").limit(n)


def duplicate_summary(assets: DataFrame) -> DataFrame:
    """One row: assets with an ISIN, ISINs that several assets have, and how many assets these are."""
    sizes = assets.where("isin is not null").groupBy("isin").agg(F.count(F.lit(1)).alias("n"))
    several = F.col("n") > 1
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("with_isin"), F.count_if(several).alias("duplicated"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).cast("long").alias("affected"))


def imported(known: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets and listings after an import of valid ``rows`` (ordinal, isin, ticker, name, currency, type) into ``known`` assets (isin, ticker, name, currency, type).

    Rows of an ISIN are one asset, which takes the first row's figures; a known one keeps its own and is filled where it has none. A ticker that a known asset or
    an earlier new one has goes to nobody else: the asset gets its ISIN as ticker. Each different ticker and currency of an ISIN is a listing.
    """
    first = ranked(rows, ["isin"], [F.col("ordinal")])
    new = first.join(known.select("isin"), "isin", "left_anti")
    taken = known.where(F.col("ticker").isNotNull()).select(F.col("ticker").alias("_t")).distinct()
    earlier = F.row_number().over(Window.partitionBy("ticker").orderBy("ordinal")) > 1
    placed = new.withColumn("_again", earlier & F.col("ticker").isNotNull()).join(taken, F.col("ticker") == F.col("_t"), "left")
    own = F.when(F.col("_again") | F.col("_t").isNotNull(), F.col("isin")).otherwise(F.col("ticker"))
    made = placed.select("isin", own.alias("ticker"), "name", "currency", "type", F.lit("created").alias("how"))
    old = known.join(first.select("isin", F.col("name").alias("_name"), F.col("currency").alias("_currency"), F.lit(True).alias("_met")), "isin", "left")
    filled_in = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) for c in ("name", "currency")]
    kept = old.select("isin", "ticker", *filled_in, "type", F.when(F.col("_met"), "updated").otherwise("kept").alias("how"))
    return kept.unionByName(made), rows.groupBy("isin", "ticker", "currency").agg(F.min("ordinal").alias("ordinal"))
