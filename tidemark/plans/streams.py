"""Streaming queries over events, run for all that is there; the SQL is their batch twin. What the watermark hasn't passed yet isn't told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import steady, steady_sql
from tidemark.session import scratch_path
from tidemark.sources import frames, stored
from tidemark.sources.adapters import brand_bars, read, tick_stream
from tidemark.streaming import stateful
from tidemark.streaming import ticks as op

from .bars import BRAND
from .quality import CHECKS


def _ntz(df, *columns: str):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """The quality queries' checks as a stream, with their times."""
    events = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    events.createOrReplaceTempView("_event_stream")
    sql = CHECKS.replace("varchar", "string").replace("from events", "from _event_stream").replace("cast(ts as date) as date", "cast(ts as timestamp) as ts")
    return spark.sql(sql).select("provider", "ts", "status")


def _open_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts that are stored as open before the stream begins: the failures of half of the providers."""
    known = read(spark, d, "events").select(F.col("event_type").alias("provider")).distinct()
    return known.where("provider < 'm'").select("provider", F.lit("canary_failed").alias("type"), F.lit("2023-12-31").cast("date").alias("opened"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return op.valid(tick_stream(spark, d)).where("event_id % 50 = 0").select("asset", "ts", (F.col("event_id") / 50 % 3 >= 1).alias("active"))


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    """Stored bars after two batches: a quarter with doubled closes and new assets, then volumes alone."""
    path, bars = scratch_path(spark), brand_bars(spark, d)
    stored.upsert_stored(path, bars, ["asset", "ts"])
    quarter = bars.where("ts >= '1996-03-01' and ts < '1996-06-01'")
    doubled = quarter.withColumn("close", F.col("close") * 2)
    stored.upsert_stored(path, doubled.union(doubled.withColumn("asset", F.concat("asset", F.lit("x")))), ["asset", "ts"])
    stored.upsert_stored(path, bars.where("ts >= '1996-05-01' and ts < '1996-07-01'").withColumn("volume", -F.col("volume")), ["asset", "ts"], update=["volume"])
    return stored.stored(spark, path).select("asset", "ts", steady("close").alias("close"), "volume")


def _framed_bars(spark: SparkSession, d: str, **options) -> DataFrame:
    """Brands' bars as stored frames, a message for each brand and year, read back by the data source."""
    path = scratch_path(spark)
    bar = F.concat(F.lit('{"v":['), F.concat_ws(",", F.unix_timestamp(F.col("ts").cast("timestamp")), "open", "high", "low", "close", "volume"), F.lit("]}"))
    years = brand_bars(spark, d).groupBy("asset", F.date_format("ts", "yyyy").alias("period")).agg(F.concat_ws(",", F.collect_list(bar)).alias("bars"))  # at most 366 days
    payload = F.concat(F.lit('{"m":"timescale_update","p":["s",{"sds_1":{"s":['), "bars", F.lit("]}}]}"))
    years.select("asset", "period", F.concat(F.lit("~m~5~m~hello~m~"), F.length(payload).cast("string"), F.lit("~m~"), payload).alias("value")).repartition("asset").write.partitionBy("asset", "period").text(path)
    frames.register(spark)
    return spark.read.format("quote_frames").options(path=path, **options).load()


def _framed_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of events as files of frames, streamed by the data source and parsed."""
    path = scratch_path(spark)
    e = read(spark, d, "events")
    payload = F.to_json(F.struct(F.col("event_type").alias("ticker"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("Timestamp"), F.col("value").alias("close"), F.get_json_object("props", "$.k").try_cast("bigint").alias("volume")))
    e.select(F.concat(F.lit("~m~"), F.length(payload).cast("string"), F.lit("~m~"), payload).alias("value")).write.text(path)
    frames.register(spark)
    return op.valid(op.parsed(spark.readStream.format("tick_frames").option("path", path).load())).select("asset", "ts", "price", "volume")


#: Messages of many shapes: keys of either case, times as seconds, ISO text, under another key, absent or broken, closes that are 0, negative, text or absent, volumes below 0, with decimals or broken.
MESSAGES = """select event_id, '{"' || case when event_id % 2 = 0 then 'ticker' else 'Ticker' end || '":"' || event_type || '"'
  || case event_id % 7 when 0 then '' when 1 then ',"close":0,"Close":7.5' when 2 then ',"close":-3' when 3 then ',"Close":"12.25"' when 4 then ',"close":"n/a"' else ',"close":' || cast(event_id as varchar) || '.5' end
  || case event_id % 5 when 0 then ',"timestamp":1704067200' when 1 then ',"time":"2024-01-02T03:04:05"' when 2 then ',"timestamp":0,"time":1704067201.5' when 3 then '' when 4 then case when event_id % 3 = 0 then ',"timestamp":"soon"' else ',"timestamp":"2024-01-02T03:04:05+01:00"' end end
  || case event_id % 6 when 0 then ',"volume":-4' when 1 then ',"Volume":' || cast(event_id as varchar) when 2 then ',"volume":7.9' when 3 then ',"volume":"many"' else '' end
  || case event_id % 4 when 0 then ',"open":1.5,"High":2' when 1 then ',"low":"x"' else '' end || '}' as json from events"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    events = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    events.createOrReplaceTempView("_message_events")
    return spark.sql(MESSAGES.replace("varchar", "string").replace("from events", "from _message_events"))


def _kept_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars that a stream upserts into a stored table, of which the last seven days before the newest one are kept."""
    path = scratch_path(spark)
    bars = op.minute_bars(op.valid(tick_stream(spark, d)), "5 minutes")
    stored.upsert_stream(bars, path, ["asset", "ts"], f"{path}-state", keep_days=7).awaitTermination()
    return _ntz(stored.stored(spark, path).select("asset", "ts", "open", "close", "volume"), "ts")


_DAYS = f"""with c as ({CHECKS.replace("from events", ", ts from events")}), w as (select date_trunc('milliseconds', max(ts)) - interval 1 day as w from events),
  h as (select provider, date, count(*) filter (where status in ('out_of_range', 'outlier')) as bad, round(count(*) filter (where status = 'ok') / count(*), 4) as rate, bool_and(status = 'ok') as passed from c, w where date + interval 1 day <= w group by 1, 2),
  k as (select *, coalesce(sum(cast(passed as int)) over (partition by provider order by date rows between unbounded preceding and 1 preceding), 0) as era from h),
  g as (select provider, era, min(date) filter (where bad > 0) as opened, arg_min(case when bad >= 3 then 'critical' else 'warning' end, date) filter (where bad > 0) as severity, max(date) filter (where passed) as resolved from k group by 1, 2)"""
_EVENTS = """ select provider, 'canary_failed' as type, 'opened' as event, opened as date, severity from g where opened is not null and not (era = 0 and {known})
  union all select provider, 'canary_failed', 'resolved', resolved, null from g where resolved is not null and (opened is not null or (era = 0 and {known}))
  union all select provider, 'high_outlier_rate', 'opened', min(date), arg_min(case when rate < 0.7 then 'critical' else 'warning' end, date) from h where rate < 0.85 group by provider"""

QUERIES = {
    "stream_minute_bars": (
        lambda spark, d: _ntz(op.available_now(op.minute_bars(op.valid(tick_stream(spark, d)), "5 minutes"), "update", ["asset", "ts"]), "ts"),
        """select event_type as asset, time_bucket(interval 5 minutes, ts) as ts, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close,
        cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as volume from events where value > 0 group by 1, 2""",
    ),
    "stream_last_value": (
        lambda spark, d: _ntz(op.available_now(op.last_values(op.valid(tick_stream(spark, d))), "update", ["asset"]), "ts"),
        "select event_type as asset, arg_max(value, row(ts, event_id)) as price, max(ts) as ts from events where value > 0 group by 1",
    ),
    "stream_counts": (
        lambda spark, d: _ntz(op.available_now(op.counters(op.valid(tick_stream(spark, d))), "update", ["asset"]), "last_tick_at"),
        "select event_type as asset, count(*) as tick_count, max(ts) as last_tick_at from events where value > 0 group by 1",
    ),
    "stream_fresh_ticks": (
        lambda spark, d: _ntz(op.available_now(op.valid(tick_stream(spark, d), "2024-01-15 12:00:00").select("event_id", "asset", "ts", "price"), "append"), "ts"),
        "select event_id, event_type as asset, ts, value as price from events where value > 0 and ts between timestamp '2024-01-15 11:55:00' and timestamp '2024-01-15 12:01:00'",
    ),
    "stream_alerts": (lambda spark, d: op.available_now(stateful.alert_events(_checks(spark, d)), "append"), _DAYS + _EVENTS.format(known="false")),
    "stream_alerts_resumed": (lambda spark, d: op.available_now(stateful.alert_events(_checks(spark, d), _open_alerts(spark, d)), "append"), _DAYS + _EVENTS.format(known="provider < 'm'")),
    "stream_expired_values": (
        lambda spark, d: _ntz(op.available_now(stateful.expired_values(op.valid(tick_stream(spark, d)), 60), "append"), "ts", "expired_at"),
        """with e as (select event_type as asset, ts, event_id, value, case when ts - lag(ts) over (partition by event_type order by ts, event_id) < interval 60 seconds then 0 else 1 end as new from events where value > 0),
        r as (select *, sum(new) over (partition by asset order by ts, event_id) as run from e)
        select asset, max(ts) as ts, arg_max(value, row(ts, event_id)) as price, max(ts) + interval 60 seconds as expired_at from r group by asset, run having max(ts) + interval 60 seconds <= (select date_trunc('milliseconds', max(ts)) - interval 5 minutes from e)""",
    ),
    "stream_subscriptions": (
        lambda spark, d: _ntz(op.available_now(stateful.subscribed_ticks(op.valid(tick_stream(spark, d)), _changes(spark, d)), "append"), "ts"),
        """with e as (select event_type as asset, ts, event_id, value as price from events where value > 0), c as (select asset, ts, event_id / 50 % 3 >= 1 as active from e where event_id % 50 = 0)
        select e.event_id, e.asset, e.ts, e.price from e asof join c on e.asset = c.asset and e.ts >= c.ts where c.active and e.ts < (select date_trunc('milliseconds', min(m)) from (select max(ts) as m from e union all select max(ts) from c)) - interval 5 minutes""",
    ),
    "source_quote_frames": (
        lambda spark, d: _framed_bars(spark, d, prune="true").where("asset in ('Brand#11', 'Brand#23') and ts >= timestamp_ntz'1995-06-15' and volume > 20").select("asset", "ts", *(steady(c).alias(c) for c in ("open", "high", "low", "close")), "volume"),
        f"with b as ({BRAND}) select asset, ts, {', '.join(f'{steady_sql(c)} as {c}' for c in ('open', 'high', 'low', 'close'))}, volume from b where asset in ('Brand#11', 'Brand#23') and ts >= '1995-06-15' and volume > 20",
    ),
    "source_newest_bars": (
        lambda spark, d: _framed_bars(spark, d, start="1998-06-01", end="1998-08-15", resolution="1D").select("asset", "ts", steady("close").alias("close")),
        f"with b as ({BRAND}), n as (select *, row_number() over (partition by asset order by ts desc) as rn from b) select asset, ts, {steady_sql('close')} as close from n where rn <= 75 and ts between '1998-06-01' and '1998-08-15'",
    ),
    "stream_framed_ticks": (
        lambda spark, d: _ntz(op.available_now(_framed_ticks(spark, d), "append"), "ts"),
        "select event_type as asset, date_trunc('second', ts) as ts, value as price, cast(json_extract_string(props, '$.k') as bigint) as volume from events where value > 0",
    ),
    "stream_parsed_ticks": (
        lambda spark, d: _ntz(op.available_now(op.valid(op.parsed(_messages(spark, d), received="2024-01-03 00:00:00")), "append"), "ts"),
        """with p as (select event_type as asset, case event_id % 7 when 1 then 7.5e0 when 2 then -3 when 3 then 12.25e0 when 5 then event_id + 0.5e0 when 6 then event_id + 0.5e0 end as price,
          case event_id % 5 when 0 then timestamp '2024-01-01 00:00:00' when 1 then timestamp '2024-01-02 03:04:05' when 2 then timestamp '2024-01-01 00:00:01.5' when 3 then timestamp '2024-01-03 00:00:00' when 4 then case when event_id % 3 <> 0 then timestamp '2024-01-02 02:04:05' end end as ts,
          case event_id % 6 when 1 then event_id when 2 then 7 end as volume, event_id % 6 = 3 as broken, case when event_id % 4 = 0 then 1.5e0 end as open, case when event_id % 4 = 0 then 2e0 end as high, cast(null as double) as low from events)
        select asset, ts, price, volume, open, high, low from p where price > 0 and ts is not null and not broken""",
    ),
    "stored_upsert": (
        _upserted,
        f"""with b as ({BRAND}) select asset, ts, {steady_sql("close * case when ts >= '1996-03-01' and ts < '1996-06-01' then 2 else 1 end")} as close, volume * case when ts >= '1996-05-01' and ts < '1996-07-01' then -1 else 1 end as volume from b
        union all select asset || 'x', ts, {steady_sql("close * 2")}, volume from b where ts >= '1996-03-01' and ts < '1996-06-01'""",
    ),
    "stream_stored_bars": (
        _kept_bars,
        """with b as (select event_type as asset, time_bucket(interval 5 minutes, ts) as ts, arg_min(value, row(ts, event_id)) as open, arg_max(value, row(ts, event_id)) as close, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as volume from events where value > 0 group by 1, 2)
        select * from b where ts >= (select date_trunc('day', max(ts)) - interval 7 days from b)""",
    ),
}
