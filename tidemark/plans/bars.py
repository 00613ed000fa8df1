"""Queries over bars, with DuckDB's SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import steady, steady_sql
from tidemark.operators import bars as op
from tidemark.sources.adapters import brand_bars, intraday_bars, read, ticks

HOURLY = """
select event_type as asset, date_trunc('hour', ts) as ts, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low,
  arg_max(value, row(ts, event_id)) as close, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as volume
from events group by 1, 2
"""
DAILY = HOURLY.replace("'hour'", "'day'")
BRAND = """
select p_brand as asset, date_trunc('day', l_shipdate) as ts, arg_min(l_extendedprice / l_quantity, k) as open, max(l_extendedprice / l_quantity) as high,
  min(l_extendedprice / l_quantity) as low, arg_max(l_extendedprice / l_quantity, k) as close, cast(sum(cast(l_quantity as bigint)) as bigint) as volume
from (select *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as k from lineitem join part on l_partkey = p_partkey) group by 1, 2
"""
BAR = ["asset", "ts", "open", "high", "low", "close", "volume"]
AS_OF = "2024-01-30 00:00:00"


def _rough(spark: SparkSession, d: str) -> DataFrame:
    """Ticks as bars with faults at fixed places."""
    t = ticks(spark, d)
    k = F.col("event_id") % 17
    price = F.col("price")
    return t.select(
        "asset",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.when(k != 1, price).alias("open"),
        F.when(k == 2, price - 5).otherwise(price + 3).alias("high"),
        F.when(k == 3, float("nan")).otherwise(price - 2).alias("low"),
        F.when(k == 4, price + 10).otherwise(price + 1).alias("close"),
        F.when(k == 5, -F.col("volume")).when(k != 6, F.col("volume")).alias("volume"),
        F.col("event_id").alias("ordinal"),
    )


NORMALISED = """
with r as (
  select event_type as asset, date_trunc('hour', ts) as ts, event_id, event_id % 17 as k, value as p, cast(json_extract_string(props, '$.k') as bigint) as v from events),
f as (select *, row_number() over (partition by asset, ts order by event_id) as rn from r),
o as (select asset, ts, p as open, case when k = 2 then p - 5 else p + 3 end as high, p - 2 as low, case when k = 4 then p + 10 else p + 1 end as close,
  case when k = 5 then -v when k <> 6 then v end as volume from f where rn = 1 and k not in (1, 3))
select asset, ts, open, greatest(open, high, low, close) as high, least(open, high, low, close) as low, close, cast(greatest(coalesce(volume, 0), 0) as bigint) as volume,
  close as adj_close, true as adjusted, 'unknown' as source from o
"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bars = intraday_bars(spark, d)
    return bars.where("day(ts) <= 20"), bars.where("day(ts) >= 15").withColumns({"close": F.col("close") + 1, "volume": F.col("volume") * 2})


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    days = brand_bars(spark, d).withColumn("resolution", F.lit("1D"))
    weeks = op.resample(days.drop("resolution").where("asset <= 'Brand#3'"), "week").withColumn("resolution", F.lit("1W"))
    return days.unionByName(weeks)


def _days(spark: SparkSession, d: str) -> DataFrame:
    r = op.history_range(brand_bars(spark, d))
    return r.withColumns({"first": F.to_date("first"), "last": F.when(F.col("n") % 2 == 0, F.lit("2001-11-30").cast("date")).otherwise(F.to_date("last"))})


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 5 + 1).cast("string"), (F.col("o_orderkey") % 5 + 1).cast("string")).alias("asset"))


SPLIT = f"with b as ({HOURLY}), e as (select * from b where day(ts) <= 20), n as (select asset, ts, open, high, low, close + 1 as close, volume * 2 as volume from b where day(ts) >= 15)"
RESAMPLED = """
select asset, date_trunc('{}', ts) as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, cast(sum(volume) as bigint) as volume
from b group by 1, date_trunc('{}', ts)
"""

QUERIES = {
    "bars_hourly": (lambda spark, d: intraday_bars(spark, d, "hour"), HOURLY),
    "bars_daily": (lambda spark, d: intraday_bars(spark, d, "day"), DAILY),
    "bars_brand_daily": (brand_bars, BRAND),
    "resample_weekly": (lambda spark, d: op.resample(brand_bars(spark, d), "week"), f"with b as ({BRAND})" + RESAMPLED.format("week", "week")),
    "resample_monthly": (lambda spark, d: op.resample(brand_bars(spark, d), "month"), f"with b as ({BRAND})" + RESAMPLED.format("month", "month")),
    "normalize_bars": (lambda spark, d: op.normalise(_rough(spark, d)), NORMALISED),
    "upsert_bars": (
        lambda spark, d: op.upsert(*_halves(spark, d), keys=["asset", "ts"], time="ts"),
        SPLIT + " select * from n union all select e.* from e anti join n on e.asset = n.asset and e.ts = n.ts",
    ),
    "upsert_partial": (
        lambda spark, d: op.upsert(*_halves(spark, d), keys=["asset", "ts"], update=["close"], time="ts"),
        SPLIT + """ select coalesce(e.asset, n.asset) as asset, coalesce(e.ts, n.ts) as ts, coalesce(e.open, n.open) as open, coalesce(e.high, n.high) as high,
          coalesce(e.low, n.low) as low, coalesce(n.close, e.close) as close, coalesce(e.volume, n.volume) as volume from e full join n on e.asset = n.asset and e.ts = n.ts""",
    ),
    "insert_absent": (
        lambda spark, d: op.insert_absent(*_halves(spark, d), keys=["asset", "ts"], time="ts"),
        SPLIT + " select * from e union all select n.* from n anti join e on e.asset = n.asset and e.ts = n.ts",
    ),
    "history_weekly": (
        lambda spark, d: op.history(_mixed(spark, d), "1W", "1996-01-01", "1999-12-31"),
        f"""with b as ({BRAND}), w as ({RESAMPLED.format("week", "week")})
        select *, '1W' as resolution from w where ts between '1996-01-01' and '1999-12-31'""",
    ),
    "history_range": (lambda spark, d: op.history_range(brand_bars(spark, d)), f"with b as ({BRAND}) select asset, min(ts) as first, max(ts) as last, count(*) as n from b group by 1"),
    "latest_n_bars": (lambda spark, d: op.latest(intraday_bars(spark, d), 50), f"with b as ({HOURLY}) select * from b qualify row_number() over (partition by asset order by ts desc) <= 50"),
    "gap_ranges": (
        lambda spark, d: op.gap_ranges(_days(spark, d), "2001-12-01", "1994-06-01"),
        f"""with b as ({BRAND}), r as (select asset, cast(min(ts) as date) as first, cast(max(ts) as date) as last, count(*) as n from b group by 1),
        s as (select asset, first, case when n % 2 = 0 then date '2001-11-30' else last end as last from r)
        select asset, case when last >= date '2001-11-30' then date '1994-06-01' else last + 1 end as fetch_from,
          case when last >= date '2001-11-30' then first - 1 else date '2001-12-01' end as fetch_to, false as up_to_date from s""",
    ),
    "missing_days": (
        lambda spark, d: op.missing_days(brand_bars(spark, d)),
        f"""with b as ({BRAND}), r as (select asset, min(ts) as lo, max(ts) as hi from b group by 1),
        c as (select asset, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from r)
        select asset, day from c anti join b on b.asset = c.asset and cast(b.ts as date) = c.day where isodow(day) < 6""",
    ),
    "retention_cut": (
        lambda spark, d: op.retained(ticks(spark, d), "ts", AS_OF, 10).select("event_id", "asset", "ts", "price"),
        f"select event_id, event_type as asset, ts, value as price from events where ts >= timestamp '{AS_OF}' - interval 10 days",
    ),
    "asof_price": (
        lambda spark, d: op.asof(_orders(spark, d), brand_bars(spark, d).select("asset", "ts", "close"), "asset", "ts", "close").select("order_id", "asset", "ts", steady("close").alias("close")),
        f"""with b as ({BRAND}), o as (
          select o_orderkey as order_id, cast(o_orderdate as timestamp) as ts, 'Brand#' || cast(o_custkey % 5 + 1 as varchar) || cast(o_orderkey % 5 + 1 as varchar) as asset from orders)
        select order_id, o.asset, o.ts, {steady_sql("close")} as close from o asof left join b on o.asset = b.asset and o.ts >= b.ts""",
    ),
}
