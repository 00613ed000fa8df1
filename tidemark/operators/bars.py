"""Bars of open, high, low, close and volume: normalisation, upserts, gaps, resampling, retention, reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]


def ranked(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def normalise(bars: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One clean bar for each (asset, ts): the first by ``ordinal`` takes its time, even if a missing price then drops it.

    A high below its low is swapped with it, then high and low are stretched to hold open and close; volume is at least 0.
    """
    one = ranked(bars, ["asset", "ts"], [F.col(ordinal)])
    whole = one.where(" and ".join(f"{c} is not null and not isnan({c})" for c in PRICES))
    swapped = whole.withColumns({"high": F.greatest("high", "low"), "low": F.least("high", "low")})
    stretched = swapped.withColumns({"high": F.greatest("open", "high", "low", "close"), "low": F.least("open", "high", "low", "close")})
    added = {"volume": F.greatest(F.coalesce("volume", F.lit(0)), F.lit(0)).cast("bigint"), "adj_close": F.col("close")}
    for name, default in (("adjusted", F.lit(True)), ("source", F.lit("unknown"))):
        added[name] = F.coalesce(name, default) if name in bars.columns else default
    return stretched.withColumns(added).drop(ordinal)


def _touched(existing: DataFrame, new: DataFrame, time: str | None) -> tuple[DataFrame, DataFrame | None]:
    """``existing`` in the range of ``time`` that ``new`` spans, and the rest of it, which a scan can tell apart by its partitions and statistics."""
    if time is None:
        return existing, None
    lo, hi = new.agg(F.min(time), F.max(time)).first()
    kind = dict(existing.dtypes)[time]
    inside = F.col(time).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)) if lo is not None else F.lit(False)
    return existing.where(F.coalesce(inside, F.lit(True))), existing.where(F.coalesce(~inside, F.lit(False)))


def _same(keys: list[str]) -> Column:
    return F.expr(" and ".join(f"e.{k} <=> n.{k}" for k in keys))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None, time: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``new``, both unique by ``keys``: new keys are added, of known ones the ``update`` columns are replaced.

    A parquet table has no MERGE; the result is written over the partitions that ``new`` touches. With ``time``, one of the keys, stored
    rows outside the range of ``new`` pass through without a join or a shuffle; inside, stored rows are joined by key.
    """
    inside, rest = _touched(existing, new, time)
    e, n = inside.alias("e"), new.alias("n")
    if update is None or set(update) | set(keys) >= set(existing.columns):
        out = e.join(n.select(*keys).alias("n"), _same(keys), "left_anti").unionByName(new)
    else:
        joined = inside.withColumn("_e", F.lit(True)).alias("e").join(new.withColumn("_n", F.lit(True)).alias("n"), _same(keys), "full")
        picked = []
        for c in existing.columns:
            from_new = F.col(f"n.{c}") if c in new.columns else F.lit(None)
            picked.append(F.when(F.col("_e").isNull() | (F.col("_n").isNotNull() & F.lit(c in update)), from_new).otherwise(F.col(f"e.{c}")).alias(c))
        out = joined.select(*picked)
    return out if rest is None else rest.unionByName(out)


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], time: str | None = None) -> DataFrame:
    """``existing`` and those rows of ``new`` whose keys it lacks; with ``time`` only stored rows of its range are joined."""
    inside, _ = _touched(existing, new, time)
    return existing.unionByName(new.join(inside.select(*keys), keys, "left_anti").select(*existing.columns))


def first_source(*sources: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first source that has a key."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(*keys).distinct(), keys, "left_anti").select(*out.columns))
    return out


def history_range(bars: DataFrame) -> DataFrame:
    """asset, first, last, n of each asset."""
    return bars.groupBy("asset").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of each asset that have a close."""
    return ranked(bars.where(F.col("close").isNotNull()), ["asset"], [F.desc("ts")], n)


def history(bars: DataFrame, resolution: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of one resolution (1D, 1W, 1M) in an inclusive range; an asset without bars of 1W or 1M gets them from its days."""
    own = bars.where(F.col("resolution") == resolution)
    if resolution in ("1W", "1M"):
        days = bars.where("resolution = '1D'").drop("resolution")
        made = resample(days, "week" if resolution == "1W" else "month").withColumn("resolution", F.lit(resolution))
        own = first_source(own, made.select(*own.columns), keys=["asset"])
    if start is not None:
        own = own.where(F.col("ts") >= start)
    if end is not None:
        own = own.where(F.col("ts") <= end)
    return own


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a longer ``unit``; weeks begin on Monday."""
    kind = dict(bars.dtypes)["ts"]
    return bars.groupBy("asset", F.date_trunc(unit, "ts").cast(kind).alias("ts")).agg(
        F.min_by("open", F.col("ts")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.col("ts")).alias("close"),
        F.sum("volume").cast("bigint").alias("volume"),
    )


def gap_ranges(ranges: DataFrame, today: str, start: str | None = None, end: str | None = None, force: bool = False, days: int = 3650) -> DataFrame:
    """What is left to fetch of each asset of ``ranges`` (asset, first, last, n; dates): fetch_from, fetch_to, up_to_date."""
    day = F.lit(today).cast("date")
    asked, until = F.lit(start).cast("date"), F.coalesce(F.lit(end).cast("date"), day)
    far = F.coalesce(asked, F.date_sub(day, days))
    first, last = F.col("first").cast("date"), F.col("last").cast("date")
    all_of_it = F.lit(force) | (F.coalesce("n", F.lit(0)) == 0)
    fresh = last >= F.date_sub(day, 1)
    before = asked.isNotNull() & (asked < first)
    begin = F.when(all_of_it, far).when(fresh, F.when(before, asked)).otherwise(F.date_add(last, 1))
    finish = F.when(all_of_it, until).when(fresh, F.date_sub(first, 1)).otherwise(until)
    due = F.when(all_of_it, F.lit(True)).when(fresh, before).otherwise(begin < finish)
    return ranges.select("asset", F.when(due, begin).alias("fetch_from"), F.when(due, finish).alias("fetch_to"), (~due).alias("up_to_date"))


def missing_days(bars: DataFrame) -> DataFrame:
    """asset, day: the weekdays between an asset's first and last bar that have none.

    Each bar looks at the next one only, so no calendar is joined.
    """
    days = bars.select("asset", F.to_date("ts").alias("day")).distinct()
    after = days.withColumn("next", F.lead("day").over(Window.partitionBy("asset").orderBy("day")))
    holes = after.where(F.datediff("next", "day") > 1).select("asset", F.explode(F.sequence(F.date_add("day", 1), F.date_sub("next", 1))).alias("day"))
    return holes.where(F.weekday("day") < 5)


def retained(rows: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """``rows`` of the last ``days`` before ``as_of``."""
    return rows.where(F.col(time) >= F.expr(f"timestamp_ntz'{as_of}' - interval {int(days)} days"))


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str, bucket: str = "month") -> DataFrame:
    """``left`` (key, time, ...) with the ``value`` of ``right`` that is latest at its time.

    Both sides are stacked and one window carries the last value on, so there is no range join; ``right`` comes first at equal times. A window
    spans one ``bucket`` of a key, so a hot key is many tasks; what a bucket hands on to the next ones is a row for each key and
    bucket, found by a second window over these rows alone.
    """
    names = [c for c in left.columns if c != value]
    known = right.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(key, time, value)
    stacked = left.select(*names, F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.lit(1).alias("_side")).unionByName(known.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    stacked = stacked.withColumn("_bucket", F.date_trunc(bucket, time))
    w = Window.partitionBy(key, "_bucket").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = stacked.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")
    ends = stacked.groupBy(key, "_bucket").agg(F.max_by(value, F.when(F.col("_side") == 0, F.col(time))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.last("_end", ignorenulls=True).over(before).alias("_handed")).where("_handed is not null and _b is not null")
    joined = inside.join(handed, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")), "left")
    return joined.withColumn(value, F.coalesce(value, "_handed")).drop("_bucket", "_key", "_b", "_handed")
