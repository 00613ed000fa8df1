"""Eighteen technical indicators over bars (asset, ts, open, high, low, close, volume), and frames made of them.

Those that look back over a fixed number of bars are window expressions. The recursive ones (exponential and Wilder averages) run in one
pass over the sorted bars of a partition: a few numbers of state are carried from batch to batch, so no asset's history is held in memory.

A task reads an asset at a time. Where an asset holds much of all rows, ``chunk_rows`` cuts its history into chunks of whole days, each with so many
bars before it that windows are whole and older weights of the recursive averages are below 1e-18; running sums add up the chunks before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import steady

from .bars import latest

def _order():
    return Window.partitionBy("asset").orderBy("ts")


def _last(n: int):
    return _order().rowsBetween(1 - n, 0)


def _full(x: Column, n: int, value: Column) -> Column:
    """``value`` where all of the last ``n`` bars have ``x``."""
    return F.when(F.count(x).over(_last(n)) == n, value)


def _mean(x: Column, n: int) -> Column:
    return _full(x, n, F.avg(x).over(_last(n)))


def _before(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(_order())


def _typical() -> Column:
    return F.expr("(high + low + close) / 3")


def _sma(df: DataFrame, length: int) -> DataFrame:
    return df.withColumn(f"SMA_{length}", _mean(F.col("close"), length))


def _wma(df: DataFrame, length: int) -> DataFrame:
    weighted = F.aggregate(F.transform(F.collect_list(F.col("close")).over(_last(length)), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(f"WMA_{length}", _full(F.col("close"), length, weighted / (length * (length + 1) / 2)))


def _vwap(df: DataFrame) -> DataFrame:
    day = Window.partitionBy("asset", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("VWAP_D", F.try_divide(F.sum(_typical() * F.col("volume")).over(day), F.sum(F.col("volume")).over(day)))


def _stoch(df: DataFrame, k: int, d: int, smooth_k: int) -> DataFrame:
    name = f"{k}_{d}_{smooth_k}"
    low, high = F.min(F.col("low")).over(_last(k)), F.max(F.col("high")).over(_last(k))
    df = df.withColumn("_raw", _full(F.col("close"), k, 100 * F.try_divide(F.col("close") - low, F.nullif(high - low, F.lit(0.0)))))
    df = df.withColumn(f"STOCHk_{name}", _mean(F.col("_raw"), smooth_k))
    return df.withColumn(f"STOCHd_{name}", _mean(F.col(f"STOCHk_{name}"), d)).drop("_raw")


def _cci(df: DataFrame, length: int) -> DataFrame:
    df = df.withColumns({"_tp": _typical()}).withColumns({"_m": F.avg("_tp").over(_last(length)), "_all": F.collect_list("_tp").over(_last(length))})
    away = F.aggregate(F.transform("_all", lambda x: F.abs(x - F.col("_m"))), F.lit(0.0), lambda s, x: s + x) / length
    return df.withColumn(f"CCI_{length}_0.015", _full(F.col("_tp"), length, F.try_divide(F.col("_tp") - F.col("_m"), F.lit(0.015) * away))).drop("_tp", "_m", "_all")


def _roc(df: DataFrame, length: int) -> DataFrame:
    return df.withColumn(f"ROC_{length}", 100 * (F.try_divide(F.col("close"), _before(F.col("close"), length)) - 1))


def _mom(df: DataFrame, length: int) -> DataFrame:
    return df.withColumn(f"MOM_{length}", F.col("close") - _before(F.col("close"), length))


def _bbands(df: DataFrame, length: int, std: float, ddof: int = 1) -> DataFrame:
    tail = f"{length}_{float(std)}_{float(std)}"
    spread = F.stddev_pop(F.col("close")).over(_last(length)) * (length / (length - ddof)) ** 0.5 * std
    df = df.withColumns({"_m": _mean(F.col("close"), length), "_s": spread})
    m, s = F.col("_m"), F.col("_s")
    return df.withColumns({f"BBL_{tail}": m - s, f"BBM_{tail}": m, f"BBU_{tail}": m + s, f"BBB_{tail}": F.try_divide(200 * s, m), f"BBP_{tail}": F.try_divide(F.col("close") - (m - s), F.nullif(2 * s, F.lit(0.0)))}).drop("_m", "_s")


def _running(df: DataFrame, name: str, step: Column) -> DataFrame:
    """The sum of ``step`` so far. In chunks, only their own bars count, and the sums of the chunks before are joined."""
    chunks = "_chunk" in df.columns
    df = df.withColumn("_step", step)
    if chunks:
        df = df.withColumn("_step", F.when(F.col("_own"), F.col("_step")).otherwise(0.0))
    out = df.withColumn(name, F.sum("_step").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    if chunks:
        sums = df.groupBy("_asset", "_chunk").agg(F.sum("_step").alias("_sum"))
        before = Window.partitionBy("_asset").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        out = out.join(sums.select("_asset", "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_past")), ["_asset", "_chunk"]).withColumn(name, F.col(name) + F.col("_past")).drop("_past")
    return out.drop("_step")


def _obv(df: DataFrame) -> DataFrame:
    return _running(df, "OBV", F.coalesce(F.signum(F.col("close") - _before(F.col("close"))), F.lit(1.0)) * F.col("volume"))


def _ad(df: DataFrame) -> DataFrame:
    flow = F.when(F.col("high") == F.col("low"), 0.0).otherwise(F.try_divide(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low"))) * F.col("volume")
    return _running(df, "AD", flow)


def _mfi(df: DataFrame, length: int) -> DataFrame:
    df = df.withColumn("_tp", _typical())
    tp, before = F.col("_tp"), F.lag("_tp").over(_order())
    df = df.withColumns({"_p": F.when(tp > before, tp * F.col("volume")).otherwise(0.0), "_n": F.when(tp < before, tp * F.col("volume")).otherwise(0.0)})
    p, n = F.sum("_p").over(_last(length)), F.sum("_n").over(_last(length))
    return df.withColumn(f"MFI_{length}", _full(tp, length, 100 * F.try_divide(p, F.nullif(p + n, F.lit(0.0))))).drop("_tp", "_p", "_n")


# --- recursive averages, fed batch by batch ---


class Average:
    """y' = y + alpha * (x - y). With ``seed`` the first value is the mean of the first n and nothing comes before; else it is the first x."""

    def __init__(self, n: int, alpha: float, seed: bool = True):
        self.n, self.alpha, self.seed, self.first, self.y = n, alpha, seed, [], None

    def feed(self, x: np.ndarray) -> np.ndarray:
        """Leading NaN values stay NaN and aren't counted."""
        out = np.full(len(x), np.nan)
        i = 0
        while self.y is None and i < len(x):
            if not np.isnan(x[i]):
                self.first.append(x[i])
                if len(self.first) == (self.n if self.seed else 1):
                    self.y = out[i] = float(np.mean(self.first))
            i += 1
        if i < len(x):
            out[i:] = pd.Series(np.concatenate(([self.y], x[i:]))).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[1:]
            self.y = out[-1]
        return out


def _ema(n: int) -> Average:
    return Average(n, 2 / (n + 1))


class Previous:
    """The value of the bar before."""

    def __init__(self) -> None:
        self.x = np.nan

    def feed(self, x: np.ndarray) -> np.ndarray:
        out = np.concatenate(([self.x], x[:-1]))
        self.x = x[-1]
        return out


class TrueRange:
    def __init__(self) -> None:
        self.before = Previous()

    def feed(self, f: dict[str, np.ndarray]) -> np.ndarray:
        p = self.before.feed(f["close"])
        return np.fmax(f["high"] - f["low"], np.fmax(np.abs(f["high"] - p), np.abs(f["low"] - p)))


class Ema:
    def __init__(self, length: int, times: int = 1):
        self.stages = [_ema(length) for _ in range(times)]

    def feed(self, f: dict[str, np.ndarray]) -> list[np.ndarray]:
        e = [f["close"]]
        for s in self.stages:
            e.append(s.feed(e[-1]))
        return [e[1] if len(e) == 2 else 2 * e[1] - e[2] if len(e) == 3 else 3 * (e[1] - e[2]) + e[3]]


class Rsi:
    def __init__(self, length: int):
        self.before, self.up, self.down = Previous(), Average(1, 1 / length, False), Average(1, 1 / length, False)

    def feed(self, f: dict[str, np.ndarray]) -> list[np.ndarray]:
        step = f["close"] - self.before.feed(f["close"])
        up, down = self.up.feed(np.maximum(step, 0)), self.down.feed(np.maximum(-step, 0))
        with np.errstate(invalid="ignore"):
            return [100 * up / (up + down)]


class Macd:
    def __init__(self, fast: int, slow: int, signal: int):
        self.fast, self.slow, self.signal = _ema(fast), _ema(slow), _ema(signal)

    def feed(self, f: dict[str, np.ndarray]) -> list[np.ndarray]:
        m = self.fast.feed(f["close"]) - self.slow.feed(f["close"])
        s = self.signal.feed(m)
        return [m, m - s, s]


class Atr:
    """Wilder's average from the first bar on, told from bar ``length`` on."""

    def __init__(self, length: int):
        self.range, self.average, self.left = TrueRange(), Average(1, 1 / length, False), length - 1

    def feed(self, f: dict[str, np.ndarray]) -> list[np.ndarray]:
        out = self.average.feed(self.range.feed(f))
        hidden = min(self.left, len(out))
        self.left -= hidden
        out[:hidden] = np.nan
        return [out]


class Keltner:
    def __init__(self, length: int, scalar: float):
        self.basis, self.range, self.band, self.scalar = _ema(length), TrueRange(), _ema(length), scalar

    def feed(self, f: dict[str, np.ndarray]) -> list[np.ndarray]:
        b, r = self.basis.feed(f["close"]), self.scalar * self.band.feed(self.range.feed(f))
        return [b - r, b, b + r]


@dataclass(frozen=True)
class Indicator:
    label: str
    defaults: dict[str, float] = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    window: Callable | None = None
    recursive: Callable | None = None
    unit: str = "price"
    min_bars: Callable[[dict], int] = lambda p: int(p.get("length", 2))
    intraday: bool = False
    levels: int = 1

    def look_back(self, p: dict) -> int:
        """Bars before a bar that it depends on, to the precision of a double."""
        return math.ceil(sum(p.values()) * (60 * self.levels if self.recursive else 1)) + 2

    def names(self, p: dict) -> list[str]:
        return [c.format(**p) for c in self.columns]


CATALOG: dict[str, Indicator] = {
    "sma": Indicator("Simple moving average", {"length": 20}, ("SMA_{length}",), _sma),
    "ema": Indicator("Exponential moving average", {"length": 20}, ("EMA_{length}",), recursive=Ema),
    "wma": Indicator("Weighted moving average", {"length": 20}, ("WMA_{length}",), _wma),
    "dema": Indicator("Double exponential average", {"length": 20}, ("DEMA_{length}",), recursive=lambda length: Ema(length, 2), levels=2),
    "tema": Indicator("Triple exponential average", {"length": 20}, ("TEMA_{length}",), recursive=lambda length: Ema(length, 3), levels=3),
    "vwap": Indicator("Volume-weighted price of the day", {}, ("VWAP_D",), _vwap, intraday=True),
    "rsi": Indicator("Relative strength", {"length": 14}, ("RSI_{length}",), recursive=Rsi, unit="percent", min_bars=lambda p: p["length"] + 1),
    "macd": Indicator("Convergence and divergence of averages", {"fast": 12, "slow": 26, "signal": 9}, ("MACD_{fast}_{slow}_{signal}", "MACDh_{fast}_{slow}_{signal}", "MACDs_{fast}_{slow}_{signal}"), recursive=Macd, min_bars=lambda p: p["slow"] + p["signal"]),
    "stoch": Indicator("Stochastic oscillator", {"k": 14, "d": 3, "smooth_k": 3}, ("STOCHk_{k}_{d}_{smooth_k}", "STOCHd_{k}_{d}_{smooth_k}"), _stoch, unit="percent", min_bars=lambda p: p["k"] + p["d"]),
    "cci": Indicator("Commodity channel", {"length": 20}, ("CCI_{length}_0.015",), _cci, unit="index"),
    "roc": Indicator("Rate of change", {"length": 10}, ("ROC_{length}",), _roc, unit="percent"),
    "mom": Indicator("Momentum", {"length": 10}, ("MOM_{length}",), _mom),
    "bbands": Indicator("Bollinger bands", {"length": 20, "std": 2.0}, tuple(f"BB{x}_{{length}}_{{std}}_{{std}}" for x in "LMUBP"), _bbands),
    "atr": Indicator("Average true range", {"length": 14}, ("ATRr_{length}",), recursive=Atr),
    "kc": Indicator("Keltner channels", {"length": 20, "scalar": 2}, ("KCLe_{length}_{scalar}", "KCBe_{length}_{scalar}", "KCUe_{length}_{scalar}"), recursive=Keltner),
    "obv": Indicator("On-balance volume", {}, ("OBV",), _obv, unit="volume"),
    "ad": Indicator("Accumulation and distribution", {}, ("AD",), _ad, unit="volume"),
    "mfi": Indicator("Money flow", {"length": 14}, ("MFI_{length}",), _mfi, unit="percent"),
}


def parse(spec: str) -> tuple[str, dict]:
    """``rsi_14`` to ("rsi", {"length": 14}): the number after the name sets the first parameter; what isn't a number is ignored."""
    name, _, rest = spec.strip().lower().partition("_")
    if name not in CATALOG:
        raise ValueError(f"no indicator is named {name!r}")
    p = dict(CATALOG[name].defaults)
    if rest and p:
        for kind in (int, float):
            try:
                p[next(iter(p))] = kind(rest)
                break
            except ValueError:
                continue
    return name, p


def _chunked(bars: DataFrame, look_back: int, chunk_rows: int) -> DataFrame:
    """``bars`` with asset as a key of asset and chunk (the asset itself in _asset), _chunk, and _own: false for copies of the bars before a chunk.

    Bars are counted by asset and day, and the running counts, a row for each asset and day, tell where chunks begin.
    """
    if chunk_rows < 2 * look_back:
        raise ValueError(f"chunks of {chunk_rows} bars are too short for {look_back} bars before them")
    days = bars.groupBy("asset", F.to_date("ts").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("asset").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    placed = days.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_chunk", F.floor(F.col("_start") / chunk_rows))
    first = placed.groupBy("asset", "_chunk").agg(F.min("_start").alias("_first"))
    order = Window.partitionBy("asset").orderBy("_chunk")
    nexts = first.select("asset", "_chunk", F.lead("_chunk").over(order).alias("_next"), F.lead("_first").over(order).alias("_next_first"))
    calendar = placed.join(nexts, ["asset", "_chunk"]).drop("_n")
    rows = bars.withColumn("_day", F.to_date("ts")).join(calendar, ["asset", "_day"])
    at = F.col("_start") + F.row_number().over(Window.partitionBy("asset", "_day").orderBy("ts")) - 1
    again = F.when(at >= F.col("_next_first") - look_back, F.col("_next"))
    out = rows.withColumn("_again", again).withColumn("_c", F.explode(F.array_compact(F.array("_chunk", "_again"))))
    out = out.withColumns({"_own": F.col("_c") == F.col("_chunk"), "_asset": F.col("asset"), "asset": F.concat_ws("\u0001", F.col("asset").cast("string"), F.col("_c").cast("string"))})
    return out.drop("_day", "_start", "_chunk", "_next", "_next_first", "_again").withColumnRenamed("_c", "_chunk")


def indicators(bars: DataFrame, specs: list[str | tuple[str, dict]], chunk_rows: int | None = None) -> DataFrame:
    """``bars`` with the columns of each of ``specs``, all from one scan and one shuffle by asset. Values stay null until there are bars enough.

    An asset's bars pass through one task as a sorted stream, whatever their number, and its averages keep a few numbers. A caller that would rather have an asset in many tasks can deal it
    out in chunks of ``chunk_rows`` bars, each with enough bars before it. Only a series that hasn't moved for so long that its past weighs nothing differs: its RSI is null.
    """
    if chunk_rows is not None:
        parsed = [parse(s) if isinstance(s, str) else (s[0], {**CATALOG[s[0]].defaults, **s[1]}) for s in specs]
        chunks = _chunked(bars, max(CATALOG[n].look_back(p) for n, p in parsed), chunk_rows)
        out = indicators(chunks, specs).where("_own").withColumn("asset", F.col("_asset")).drop("_asset", "_chunk", "_own")
        return out.select(*bars.columns, *(F.col(f"`{c}`") for c in out.columns if c not in bars.columns))
    parsed = [parse(s) if isinstance(s, str) else (s[0], {**CATALOG[s[0]].defaults, **s[1]}) for s in specs]
    loops = [(CATALOG[n], p) for n, p in parsed if CATALOG[n].recursive]
    out = _recursive(bars, loops) if loops else bars
    for n, p in parsed:
        if CATALOG[n].window:
            out = CATALOG[n].window(out, **p)
    return out


def _recursive(bars: DataFrame, loops: list[tuple[Indicator, dict]]) -> DataFrame:
    names = [c for i, p in loops for c in i.names(p)]
    known = bars.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asset, states = None, None
        for f in frames:
            made: list[list[np.ndarray]] = []
            edges = [0, *(np.flatnonzero(f["asset"].to_numpy()[1:] != f["asset"].to_numpy()[:-1]) + 1).tolist(), len(f)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if states is None or f["asset"].iat[a] != asset:
                    asset, states = f["asset"].iat[a], [i.recursive(**p) for i, p in loops]
                part = {c: f[c].to_numpy(np.float64)[a:b] for c in ("open", "high", "low", "close")}
                made.append([x for s in states for x in s.feed(part)])
            columns = {n: np.concatenate([m[j] for m in made]) if made else [] for j, n in enumerate(names)}
            added = pd.DataFrame(columns, index=f.index).astype("float64")
            yield pd.concat([f[known], added.astype(object).where(added.notna(), None)], axis=1)

    schema = T.StructType([*bars.schema, *(T.StructField(n, T.DoubleType()) for n in names)])
    return bars.repartition("asset").sortWithinPartitions("asset", "ts").mapInPandas(run, schema)


def long_frame(bars: DataFrame, specs: list[str]) -> DataFrame:
    """asset, ts, series, value: a row for each series and bar."""
    names = [c for n, p in map(parse, specs) for c in CATALOG[n].names(p)]
    wide = indicators(bars, specs).select("asset", "ts", *(F.col(f"`{n}`") for n in names))
    return wide.unpivot(["asset", "ts"], [f"`{n}`" for n in names], "series", "value")


def long_frame_with_errors(bars: DataFrame, specs: list[str]) -> DataFrame:
    """``long_frame`` of the specs that can be read, with a column error, and a row without an asset for each of the others."""
    good, bad = [], []
    for s in specs:
        try:
            parse(s)
            good.append(s)
        except ValueError as e:
            bad.append((s, str(e)))
    failed = bars.sparkSession.createDataFrame(bad, "series string, error string")
    if not good:
        none = bars.select("asset", "ts").limit(0).withColumns({"series": F.lit(""), "value": F.lit(0.0), "error": F.lit("")})
        return none.unionByName(failed, allowMissingColumns=True)
    return long_frame(bars, good).withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def chart(bars: DataFrame, specs: list[str], n: int = 5000) -> DataFrame:
    """A row for each asset: arrays in order of time, of its newest ``n`` bars, which is what a chart shows."""
    names = [c for n, p in map(parse, specs) for c in CATALOG[n].names(p)]
    wide = latest(indicators(bars, specs), n)
    held = wide.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("ts", "close", *(F.col(f"`{n}`").alias(f"s{i}") for i, n in enumerate(names))))).alias("_rows"))
    return held.select("asset", F.col("_rows.ts").alias("ts"), F.col("_rows.close").alias("close"), *(F.col(f"_rows.s{i}").alias(n) for i, n in enumerate(names)))


COMPARE = {"lt": "<", "gt": ">", "lte": "<=", "gte": ">="}


def screen(bars: DataFrame, spec: str, operator: str, value: float) -> DataFrame:
    """asset, value: assets whose last known value of the indicator's first series compares so with ``value``."""
    n, p = parse(spec)
    name = CATALOG[n].names(p)[0]
    found = indicators(bars, [spec]).where(F.col(f"`{name}`").isNotNull()).groupBy("asset").agg(F.max_by(F.col(f"`{name}`"), "ts").alias("value"))
    return found.where(F.expr(f"value {COMPARE[operator]} {float(value)}")).select("asset", steady("value", 2).alias("value"))


def screen_listings(bars: DataFrame, listings: DataFrame, spec: str, operator: str, value: float, most: int = 100) -> DataFrame:
    """ticker, asset, value by ``screen`` over the first ``most`` active primary ``listings`` (ticker, asset, is_active, is_primary) by ticker, each by its newest bars: 50, or thrice the period if that is more."""
    _, p = parse(spec)
    period = next((x for x in p.values() if isinstance(x, int)), 0)
    chosen = listings.where("is_active and is_primary").orderBy("ticker", "asset").limit(most).select("ticker", "asset")
    recent = latest(bars.join(chosen.select("asset").distinct(), "asset", "left_semi"), max(50, 3 * period))
    return screen(recent, spec, operator, value).join(chosen, "asset").select("ticker", "asset", "value")


def catalog_rows(spark) -> DataFrame:
    """indicator, label, unit, columns, min_bars of the whole catalog."""
    rows = [(n, i.label, i.unit, ",".join(i.names(i.defaults)), int(i.min_bars(i.defaults))) for n, i in CATALOG.items()]
    return spark.createDataFrame(rows, "indicator string, label string, unit string, columns string, min_bars int")


def catalog_over(bars: DataFrame) -> DataFrame:
    """``catalog_rows`` with assets: how many assets of ``bars`` have bars enough for the indicator."""
    rows = catalog_rows(bars.sparkSession)
    counted = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("_n")).groupBy("_n").agg(F.count(F.lit(1)).alias("_assets"))  # a row for each length
    enough = F.filter(F.array(*(F.struct(F.lit(n).alias("indicator"), F.lit(int(i.min_bars(i.defaults))).alias("least")) for n, i in CATALOG.items())), lambda x: x["least"] <= F.col("_n"))
    met = counted.select("_assets", F.explode(enough).alias("x")).groupBy("x.indicator").agg(F.sum("_assets").alias("assets"))
    return rows.join(met, "indicator", "left").withColumn("assets", F.coalesce("assets", F.lit(0)))


def labelled_frame(bars: DataFrame, specs: list[str]) -> DataFrame:
    """``long_frame`` with the label and unit of each series' indicator."""
    of_series = {c: CATALOG[n] for n, p in map(parse, specs) for c in CATALOG[n].names(p)}
    pick = lambda what: F.create_map(*(F.lit(x) for c, i in of_series.items() for x in (c, getattr(i, what))))[F.col("series")]
    return long_frame(bars, specs).withColumns({"label": pick("label"), "unit": pick("unit")})
