"""Queries over indicators of hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numbers import steady, steady_sql
from tidemark.operators import indicators as op
from tidemark.sources.adapters import brand_bars, intraday_bars, read

from .bars import BRAND, HOURLY

B = f"with recursive b as ({HOURLY})"
LAST = "(partition by asset order by ts rows between {} preceding and current row)"


def _query(spec: str, names: list[str]):
    def run(spark, d):
        n, p = op.parse(spec)
        out = op.indicators(intraday_bars(spark, d), [spec])
        return out.select("asset", "ts", *(steady(F.col(f"`{c}`")).alias(a) for c, a in zip(op.CATALOG[n].names(p), names, strict=True)))

    return run


def _told(**series: str) -> str:
    return ", ".join(f"{steady_sql(sql)} as {name}" for name, sql in series.items())


def _over(n: int) -> str:
    return LAST.format(n - 1)


def _full(x: str, n: int, value: str) -> str:
    return f"case when count({x}) over {_over(n)} = {n} then {value} end"


def _ema_ctes(name: str, source: str, x: str, n: int) -> str:
    """CTEs ``name``_in (asset, rn, ts, x) and ``name`` (asset, rn, y), the average of ``source``'s ``x`` from its first value on."""
    return f""", {name}_in as (select asset, ts, {x} as x, row_number() over (partition by asset order by ts) as rn from {source} where {x} is not null),
    {name}_rec as (
      select asset, cast({n} as bigint) as rn, avg(x) as y from {name}_in where rn <= {n} group by asset having count(*) = {n}
      union all select r.asset, r.rn + 1, r.y + 2.0 / {n + 1} * (s.x - r.y) from {name}_rec r join {name}_in s on s.asset = r.asset and s.rn = r.rn + 1),
    {name} as (select asset, ts, y from {name}_rec join {name}_in using (asset, rn))"""


def _wilder_ctes(name: str, source: str, x: str, n: int) -> str:
    return f""", {name}_in as (select asset, ts, {x} as x, row_number() over (partition by asset order by ts) as rn from {source} where {x} is not null),
    {name}_rec as (select asset, rn, x as y from {name}_in where rn = 1
      union all select r.asset, r.rn + 1, r.y + 1.0 / {n} * (s.x - r.y) from {name}_rec r join {name}_in s on s.asset = r.asset and s.rn = r.rn + 1),
    {name} as (select asset, ts, y, rn from {name}_rec join {name}_in using (asset, rn))"""


_E1 = _ema_ctes("e1", "b", "close", 20)
_E2 = _ema_ctes("e2", "e1", "y", 20)
_E3 = _ema_ctes("e3", "e2", "y", 20)
_CHANGE = ", d as (select *, close - lag(close) over (partition by asset order by ts) as step from b)"
_UP = ", g as (select asset, ts, greatest(step, 0) as up, greatest(-step, 0) as down from d where step is not null)"
_RSI = B + _CHANGE + _UP + _wilder_ctes("u", "g", "up", 14) + _wilder_ctes("v", "g", "down", 14) + ", rsi as (select b.asset, b.ts, 100 * u.y / nullif(u.y + v.y, 0) as y from b left join u using (asset, ts) left join v using (asset, ts))"
_TR = ", t as (select asset, ts, close, greatest(high - low, coalesce(abs(high - lag(close) over (partition by asset order by ts)), 0), coalesce(abs(low - lag(close) over (partition by asset order by ts)), 0)) as tr from b)"
_TP = ", p as (select *, (high + low + close) / 3 as tp from b)"

SQL = {
    "ind_sma": ("sma_20", B + f" select asset, ts, {_told(sma=_full('close', 20, f'avg(close) over {_over(20)}'))} from b"),
    "ind_wma": ("wma_20", B + f" select asset, ts, {_told(wma=_full('close', 20, f'list_sum(list_transform(list(close) over {_over(20)}, lambda x, i: x * i)) / 210'))} from b"),
    "ind_roc": ("roc_10", B + f" select asset, ts, {_told(roc='100 * (close / lag(close, 10) over (partition by asset order by ts) - 1)')} from b"),
    "ind_mom": ("mom_10", B + f" select asset, ts, {_told(mom='close - lag(close, 10) over (partition by asset order by ts)')} from b"),
    "ind_bbands": (
        "bbands_20",
        B + f", m as (select *, {_full('close', 20, f'avg(close) over {_over(20)}')} as m, 2 * stddev_samp(close) over {_over(20)} as s from b) "
        f"select asset, ts, {_told(lower='m - s', middle='m', upper='m + s', width='200 * s / nullif(m, 0)', place='(close - (m - s)) / nullif(2 * s, 0)')} from m",
    ),
    "ind_stoch": (
        "stoch_14",
        B + f", r as (select *, {_full('close', 14, f'100 * (close - min(low) over {_over(14)}) / nullif(max(high) over {_over(14)} - min(low) over {_over(14)}, 0)')} as raw from b), "
        f"k as (select *, {_full('raw', 3, f'avg(raw) over {_over(3)}')} as k from r) select asset, ts, {_told(k='k', d=_full('k', 3, f'avg(k) over {_over(3)}'))} from k",
    ),
    "ind_cci": (
        "cci_20",
        B + _TP + f", a as (select *, avg(tp) over {_over(20)} as m, list(tp) over {_over(20)} as l from p) "
        f"select asset, ts, {_told(cci='case when len(l) = 20 then (tp - m) / nullif(0.015 * list_sum(list_transform(l, lambda x: abs(x - m))) / 20, 0) end')} from a",
    ),
    "ind_mfi": (
        "mfi_14",
        B + _TP + ", f as (select *, case when tp > lag(tp) over (partition by asset order by ts) then tp * volume else 0 end as up, case when tp < lag(tp) over (partition by asset order by ts) then tp * volume else 0 end as down from p) "
        f"select asset, ts, {_told(mfi=_full('tp', 14, f'100 * sum(up) over {_over(14)} / nullif(sum(up) over {_over(14)} + sum(down) over {_over(14)}, 0)'))} from f",
    ),
    "ind_vwap": ("vwap", B + _TP + f" select asset, ts, {_told(vwap='sum(tp * volume) over w / nullif(sum(volume) over w, 0)')} from p window w as (partition by asset, cast(ts as date) order by ts rows between unbounded preceding and current row)"),
    "ind_obv": ("obv", B + f", s as (select *, coalesce(sign(close - lag(close) over (partition by asset order by ts)), 1) * volume as step from b) select asset, ts, {_told(obv='sum(step) over (partition by asset order by ts rows between unbounded preceding and current row)')} from s"),
    "ind_ad": ("ad", B + f", s as (select *, case when high = low then 0 else (2 * close - high - low) / (high - low) end * volume as flow from b) select asset, ts, {_told(ad='sum(flow) over (partition by asset order by ts rows between unbounded preceding and current row)')} from s"),
    "ind_ema": ("ema_20", B + _E1 + f" select b.asset, b.ts, {_told(ema='e1.y')} from b left join e1 using (asset, ts)"),
    "ind_dema": ("dema_20", B + _E1 + _E2 + f" select b.asset, b.ts, {_told(dema='2 * e1.y - e2.y')} from b left join e1 using (asset, ts) left join e2 using (asset, ts)"),
    "ind_tema": ("tema_20", B + _E1 + _E2 + _E3 + f" select b.asset, b.ts, {_told(tema='3 * (e1.y - e2.y) + e3.y')} from b left join e1 using (asset, ts) left join e2 using (asset, ts) left join e3 using (asset, ts)"),
    "ind_macd": (
        "macd",
        B + _ema_ctes("f", "b", "close", 12) + _ema_ctes("s", "b", "close", 26) + ", m as (select s.asset, s.ts, f.y - s.y as y from s join f using (asset, ts))" + _ema_ctes("g", "m", "y", 9)
        + f" select b.asset, b.ts, {_told(macd='m.y', histogram='m.y - g.y', signal='g.y')} from b left join m using (asset, ts) left join g using (asset, ts)",
    ),
    "ind_rsi": ("rsi_14", _RSI + f" select asset, ts, {_told(rsi='y')} from rsi"),
    "ind_atr": ("atr_14", B + _TR + _wilder_ctes("a", "t", "tr", 14) + f" select b.asset, b.ts, {_told(atr='case when a.rn >= 14 then a.y end')} from b left join a using (asset, ts)"),
    "ind_kc": (
        "kc_20",
        B + _TR + _ema_ctes("c", "t", "close", 20) + _ema_ctes("r", "t", "tr", 20) + f" select b.asset, b.ts, {_told(lower='c.y - 2 * r.y', basis='c.y', upper='c.y + 2 * r.y')} from b left join c using (asset, ts) left join r using (asset, ts)",
    ),
}
_NAMES = {"bbands": ["lower", "middle", "upper", "width", "place"], "stoch": ["k", "d"], "macd": ["macd", "histogram", "signal"], "kc": ["lower", "basis", "upper"]}
def _listed(spark, d):
    brand = F.col("p_brand")
    return read(spark, d, "part").select(F.concat(F.lit("B"), F.right(brand, F.lit(2))).alias("ticker"), brand.alias("asset"), (F.right(brand, F.lit(1)) != "3").alias("is_active"), (F.right(brand, F.lit(2)) >= "2").alias("is_primary")).distinct()


#: What the catalog tells of each indicator, literally.
CATALOG_ROWS = """
select * from (values
  ('sma', 'Simple moving average', 'price', 'SMA_20', 20),
  ('ema', 'Exponential moving average', 'price', 'EMA_20', 20),
  ('wma', 'Weighted moving average', 'price', 'WMA_20', 20),
  ('dema', 'Double exponential average', 'price', 'DEMA_20', 20),
  ('tema', 'Triple exponential average', 'price', 'TEMA_20', 20),
  ('vwap', 'Volume-weighted price of the day', 'price', 'VWAP_D', 2),
  ('rsi', 'Relative strength', 'percent', 'RSI_14', 15),
  ('macd', 'Convergence and divergence of averages', 'price', 'MACD_12_26_9,MACDh_12_26_9,MACDs_12_26_9', 35),
  ('stoch', 'Stochastic oscillator', 'percent', 'STOCHk_14_3_3,STOCHd_14_3_3', 17),
  ('cci', 'Commodity channel', 'index', 'CCI_20_0.015', 20),
  ('roc', 'Rate of change', 'percent', 'ROC_10', 10),
  ('mom', 'Momentum', 'price', 'MOM_10', 10),
  ('bbands', 'Bollinger bands', 'price', 'BBL_20_2.0_2.0,BBM_20_2.0_2.0,BBU_20_2.0_2.0,BBB_20_2.0_2.0,BBP_20_2.0_2.0', 20),
  ('atr', 'Average true range', 'price', 'ATRr_14', 14),
  ('kc', 'Keltner channels', 'price', 'KCLe_20_2,KCBe_20_2,KCUe_20_2', 20),
  ('obv', 'On-balance volume', 'volume', 'OBV', 2),
  ('ad', 'Accumulation and distribution', 'volume', 'AD', 2),
  ('mfi', 'Money flow', 'percent', 'MFI_14', 14)
) as t(indicator, label, unit, columns, min_bars)
"""

QUERIES = {q: (_query(spec, _NAMES.get(q[4:], [q[4:]])), sql) for q, (spec, sql) in SQL.items()}
_SMA10 = f"avg(close) over {_over(10)}"
QUERIES |= {
    "multi_indicator_long": (
        lambda spark, d: op.long_frame(intraday_bars(spark, d), ["sma_10", "mom_5", "roc_3"]).withColumn("value", steady("value")),
        B + f", w as (select asset, ts, {_full('close', 10, _SMA10)} as a, close - lag(close, 5) over (partition by asset order by ts) as m, 100 * (close / lag(close, 3) over (partition by asset order by ts) - 1) as r from b) "
        f"select asset, ts, 'SMA_10' as series, {steady_sql('a')} as value from w union all select asset, ts, 'MOM_5', {steady_sql('m')} from w union all select asset, ts, 'ROC_3', {steady_sql('r')} from w",
    ),
    "chart_frame": (
        lambda spark, d: op.chart(intraday_bars(spark, d, "day"), ["sma_5"]).select("asset", F.size("ts").cast("bigint").alias("n"), F.element_at("ts", -1).alias("last_ts"), steady(F.element_at("close", -1)).alias("last_close"), steady(F.element_at(F.col("SMA_5"), -1)).alias("last_sma")),
        f"with b as ({HOURLY.replace(chr(39) + 'hour' + chr(39), chr(39) + 'day' + chr(39))}), s as (select *, {_full('close', 5, f'avg(close) over {_over(5)}')} as sma from b) "
        f"select asset, count(*) as n, max(ts) as last_ts, {steady_sql('arg_max(close, ts)')} as last_close, {steady_sql('arg_max(sma, ts)')} as last_sma from s group by 1",
    ),
    "screen_rsi_lt": (lambda spark, d: op.screen(intraday_bars(spark, d), "rsi_14", "lt", 55.0), _RSI + f", l as (select asset, arg_max(y, ts) as y from rsi where y is not null group by 1) select asset, {steady_sql('y', 2)} as value from l where y < 55"),
    "screen_mom_gt": (
        lambda spark, d: op.screen(brand_bars(spark, d), "mom_20", "gt", 0.0),
        f"with b as ({BRAND}), m as (select asset, ts, close - lag(close, 20) over (partition by asset order by ts) as y from b), l as (select asset, arg_max(y, ts) as y from m where y is not null group by 1) select asset, {steady_sql('y', 2)} as value from l where y > 0",
    ),
    "multi_indicator_errors": (
        lambda spark, d: op.long_frame_with_errors(intraday_bars(spark, d), ["mom_5", "nothing_3"]).withColumn("value", steady("value")),
        B + f", w as (select asset, ts, close - lag(close, 5) over (partition by asset order by ts) as m from b) select asset, ts, 'MOM_5' as series, {steady_sql('m')} as value, null as error from w union all select null, null, 'nothing_3', null, 'no indicator is named ' || chr(39) || 'nothing' || chr(39)",
    ),
    "screen_listings": (
        lambda spark, d: op.screen_listings(brand_bars(spark, d), _listed(spark, d), "mom_20", "gt", 0.0, 8),
        f"""with b as ({BRAND}), n as (select * from b qualify row_number() over (partition by asset order by ts desc) <= 60), m as (select asset, ts, close - lag(close, 20) over (partition by asset order by ts) as y from n), l as (select asset, arg_max(y, ts) as y from m where y is not null group by 1),
        k as (select distinct 'B' || right(p_brand, 2) as ticker, p_brand as asset from part where right(p_brand, 1) <> '3' and right(p_brand, 2) >= '2' order by 1, 2 limit 8) select ticker, asset, {steady_sql('y', 2)} as value from l join k using (asset) where y > 0""",
    ),
    "indicator_catalog": (
        lambda spark, d: op.catalog_over(intraday_bars(spark, d, "day")),
        f"with b as ({HOURLY.replace("'hour'", "'day'")}), n as (select asset, count(*) as n from b group by 1) select c.*, (select count(*) from n where n.n >= c.min_bars) as assets from ({CATALOG_ROWS}) c",
    ),
    "multi_indicator_labelled": (
        lambda spark, d: op.labelled_frame(intraday_bars(spark, d), ["sma_10", "mom_5"]).withColumn("value", steady("value")),
        f"""with b as ({HOURLY}), w as (select asset, ts, case when count(close) over l = 10 then avg(close) over l end as sma, close - lag(close, 5) over (partition by asset order by ts) as mom from b window l as (partition by asset order by ts rows between 9 preceding and current row))
        select asset, ts, 'SMA_10' as series, {steady_sql('sma')} as value, 'Simple moving average' as label, 'price' as unit from w union all select asset, ts, 'MOM_5', {steady_sql('mom')}, 'Momentum', 'price' from w""",
    ),
}
