"""Queries over data quality: users stand for tickers, event types for providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import steady, steady_sql
from tidemark.operators import quality as op
from tidemark.sources.adapters import intraday_bars, read

from .bars import HOURLY

VALUES = """
select cast(user_id as varchar) as ticker, event_type as provider, 'price' as field,
  case when user_id % 13 = 0 and length(event_type) % 2 = 0 then -1e0 when user_id % 29 = 0 and length(event_type) % 2 = 1 then null else avg(value) * case when (user_id + length(event_type)) % 7 = 0 then 3e0 else 1e0 end end as value
from events group by user_id, event_type
"""
CHECKS = """
select event_type as provider, cast(ts as date) as date, 'f' || cast(user_id % 8 as varchar) as field,
  case when (event_id * 31 + user_id) % 10 < 6 or length(event_type) + day(ts) < 12 then 'ok' when event_id % 4 = 0 then 'outlier' when event_id % 4 = 1 then 'null' when event_id % 4 = 2 then 'timeout' else 'out_of_range' end as status
from events
"""
DAILY = HOURLY.replace("'hour'", "'day'")


def _sql(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("varchar", "string").replace("from events", "from {events}"), events=read(spark, d, "events"))


def values(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, VALUES)


def checks(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, CHECKS)


def _health(spark: SparkSession, d: str) -> DataFrame:
    return op.daily_health(checks(spark, d))


V = f"with v as ({VALUES}), r as (select *, case when value is null then 'null' when value < 0.001 or value > 1e6 then 'out_of_range' else 'ok' end as s from v), m as (select ticker, field, median(value) as m, count(*) as n from r where s = 'ok' group by all having count(*) >= 2)"
J = V + ", j as (select r.*, m.m, case when s = 'ok' and abs(m.m) >= 1e-9 then abs(value - m.m) / abs(m.m) end as dev from r left join m using (ticker, field))"
H = f"""with c as ({CHECKS}), h as (select provider, date, count(*) as total, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'outlier') as outlier, count(*) filter (where status = 'out_of_range') as out_of_range,
  count(*) filter (where status in ('null', 'timeout')) as missing, count(*) filter (where status = 'timeout') as timeout, bool_and(status = 'ok') as passed, round(count(*) filter (where status = 'ok') / count(*), 4) as success_rate from c group by 1, 2)"""
A = H + """, a as (select provider, date, 'canary_failed' as type, case when out_of_range + outlier >= 3 then 'critical' else 'warning' end as severity from h where out_of_range + outlier > 0
  union all select provider, date, 'high_outlier_rate', case when success_rate < 0.7 then 'critical' else 'warning' end from h where success_rate < 0.85)"""
RANGE = f"with b as ({DAILY}), s as (select asset, avg(close) as m, stddev_samp(close) as s from b group by 1 having count(close) >= 10), r as (select asset, greatest(m - 3 * greatest(s, m * 0.02), 0.01) as low, m + 3 * greatest(s, m * 0.02) as high from s)"

QUERIES = {
    "range_check": (lambda spark, d: op.range_check(values(spark, d)).select("ticker", "provider", "status"), V + " select ticker, provider, s as status from r"),
    "consensus_median": (lambda spark, d: op.consensus(op.range_check(values(spark, d))).select("ticker", "field", steady("consensus").alias("consensus"), "n"), V + f" select ticker, field, {steady_sql('m')} as consensus, n from m"),
    "outlier_reject": (
        lambda spark, d: op.validated(values(spark, d)).select("ticker", "provider", "status", steady("consensus").alias("consensus"), steady("accepted").alias("accepted")),
        J + f" select ticker, provider, case when dev > 0.5 then 'outlier' else s end as status, {steady_sql('m')} as consensus, case when s = 'ok' and coalesce(dev, 0) <= 0.5 then {steady_sql('value')} end as accepted from j",
    ),
    "dynamic_price_range": (lambda spark, d: op.dynamic_range(intraday_bars(spark, d, "day")).select("asset", steady("low").alias("low"), steady("high").alias("high")), RANGE + f" select asset, {steady_sql('low')} as low, {steady_sql('high')} as high from r"),
    "canary_check": (
        lambda spark, d: op.canary(intraday_bars(spark, d).select("asset", "ts", F.col("close").alias("value")), op.dynamic_range(intraday_bars(spark, d, "day"))).select("asset", "ts", "passed", steady("deviation").alias("deviation")),
        RANGE + f", h as (select asset, ts, close from ({HOURLY})) select asset, ts, coalesce(close between low and high, false) as passed, {steady_sql('abs(close - (low + high) / 2) / ((low + high) / 2)')} as deviation from h left join r using (asset)",
    ),
    "daily_health": (_health, H + " select *, success_rate >= 0.85 as healthy from h"),
    "provider_health_7d": (
        lambda spark, d: op.provider_health(_health(spark, d), "2024-01-30").withColumn("rate", steady("rate")),
        H + f" select provider, {steady_sql('avg(success_rate)')} as rate, max(date) as last_date, bool_and(passed) as all_passed, case when avg(success_rate) >= 0.85 then 'OK' when avg(success_rate) >= 0.7 then 'DEGRADED' else 'DOWN' end as label from h where date > date '2024-01-30' - 7 group by 1",
    ),
    "health_stats": (
        lambda spark, d: op.status_stats(checks(spark, d)),
        f"with c as ({CHECKS}) select provider, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'outlier') as outlier, count(*) filter (where status = 'out_of_range') as out_of_range, count(*) filter (where status in ('null', 'timeout')) as missing, round(count(*) filter (where status = 'ok') / count(*), 4) as quality from c group by 1",
    ),
    "best_and_worst_providers": (
        lambda spark, d: op.best_and_worst(op.status_stats(checks(spark, d))),
        f"with c as ({CHECKS}), s as (select provider, round(count(*) filter (where status = 'ok') / count(*), 4) as quality from c group by 1), r as (select *, cast(row_number() over (order by quality desc, provider) as int) as u, cast(row_number() over (order by quality, provider desc) as int) as d from s) "
        "select provider, quality, 'best' as side, u as rank from r where u <= 3 union all select provider, quality, 'worst', d from r where d <= 2",
    ),
    "top_invalid_fields": (lambda spark, d: op.top_invalid(checks(spark, d)), f"with c as ({CHECKS}) select field, count(*) as n from c where status <> 'ok' group by 1 order by n desc, field limit 5"),
    "alerts_raised": (lambda spark, d: op.alerts(_health(spark, d)), A + " select * from a"),
    "alerts_new": (
        lambda spark, d: op.alerts(_health(spark, d).where("date > '2024-01-15'"), op.alerts(_health(spark, d).where("date = '2024-01-15'")).where("provider < 'm'")),
        A + " select * from a where date > '2024-01-15' and not exists (select 1 from a o where o.date = '2024-01-15' and o.provider < 'm' and o.provider = a.provider and o.type = a.type)",
    ),
    "alert_history": (
        lambda spark, d: op.alert_history(_health(spark, d)),
        A + """, e as (select provider, date, coalesce(sum(cast(passed as int)) over (partition by provider order by date rows between unbounded preceding and 1 preceding), 0) as era,
          min(case when passed then date end) over (partition by provider order by date rows between current row and unbounded following) as clear_day from h)
        select provider, type, min(date) as opened, arg_min(clear_day, date) filter (where clear_day is not null) as resolved, arg_min(severity, date) as severity from a join e using (provider, date) where type = 'canary_failed' group by provider, type, era
        union all select provider, type, min(date), null, arg_min(severity, date) from a where type = 'high_outlier_rate' group by provider, type""",
    ),
}
