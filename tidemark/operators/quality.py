"""Data quality across providers: ranges, median consensus, outliers, canary checks, daily health and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bars import ranked

#: Field: lowest and highest value, both allowed. Fixed values.
BOUNDS = {
    "pe_ratio": (0.5, 1000.0), "pe_forward": (0.5, 500.0), "pb_ratio": (0.0, 100.0), "ps_ratio": (0.0, 200.0), "peg_ratio": (-10.0, 50.0), "ev_ebitda": (0.0, 500.0),
    "price": (0.001, 1e6), "target_price": (0.001, 1e6), "dividend_yield": (0.0, 0.5), "dividend_rate": (0.0, 1000.0),
    "roe": (-5.0, 10.0), "roa": (-2.0, 2.0), "net_margin": (-5.0, 1.0), "operating_margin": (-5.0, 1.0), "gross_margin": (-1.0, 1.0),
    "quarterly_revenue_growth_yoy": (-0.99, 10.0), "quarterly_earnings_growth_yoy": (-0.99, 20.0), "eps_trailing": (-1000.0, 10000.0), "eps_forward": (-1000.0, 10000.0), "eps": (-1000.0, 10000.0),
    "beta": (-3.0, 5.0), "short_percent_float": (0.0, 1.0), "payout_ratio": (0.0, 10.0), "week_52_high": (0.001, 1e6), "week_52_low": (0.001, 1e6),
}
OUTLIER, HEALTHY, POOR, FAILURES = 0.5, 0.85, 0.70, 3
MOST_FIELDS = 1000  # of a table of limits that becomes part of a plan


def bounds(spark: SparkSession, table: dict[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    return spark.createDataFrame([(f, *b) for f, b in table.items()], "field string, low double, high double")


def range_check(values: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """``values`` (ticker, provider, field, value) with status: null, out_of_range or ok. Fields without limits are ok."""
    limits = F.broadcast(bounds(values.sparkSession)) if limits is None else limits  # a constant
    clean = values.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    joined = clean.join(limits, "field", "left")
    status = F.when(F.col("value").isNull(), "null").when((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), "out_of_range").otherwise("ok")
    return joined.withColumn("status", status).drop("low", "high")


def consensus(checked: DataFrame) -> DataFrame:
    """ticker, field, consensus (the median), n of the values in range, where two providers or more have one."""
    ok = checked.where("status = 'ok'").groupBy("ticker", "field").agg(F.round(F.median("value"), 6).alias("consensus"), F.count(F.lit(1)).alias("n"))
    return ok.where("n >= 2")


def validated(values: DataFrame, limits: DataFrame | None = None, most: float = OUTLIER) -> DataFrame:
    """``values`` with status (outlier too), consensus, deviation and accepted: the value, or null where it's rejected."""
    checked = range_check(values, limits)
    joined = checked.join(consensus(checked).drop("n"), ["ticker", "field"], "left")
    deviation = F.when((F.col("status") == "ok") & (F.abs("consensus") >= 1e-9), F.abs(F.col("value") - F.col("consensus")) / F.abs("consensus"))
    out = joined.withColumn("deviation", F.round(deviation, 4)).withColumn("status", F.when(deviation > most, "outlier").otherwise(F.col("status")))
    return out.withColumn("accepted", F.when(F.col("status") == "ok", F.col("value")))


def dynamic_range(closes: DataFrame, least: int = 10) -> DataFrame:
    """asset, low, high from ``closes`` (asset, close): three deviations around the mean, of at least 2 % of it."""
    s = closes.groupBy("asset").agg(F.avg("close").alias("m"), F.stddev_samp("close").alias("s"), F.count("close").alias("n")).where(F.col("n") >= least)
    spread = 3 * F.greatest("s", F.col("m") * 0.02)
    return s.select("asset", F.greatest(F.col("m") - spread, F.lit(0.01)).alias("low"), (F.col("m") + spread).alias("high"))


def with_dynamic_bounds(limits: DataFrame, ranges: DataFrame, field: str = "price") -> DataFrame:
    """asset, field, low, high: ``limits`` (field, low, high) for each asset of ``ranges`` (asset, low, high), whose own range replaces that of ``field``."""
    known = limits.select("field", "low", "high").limit(MOST_FIELDS + 1).collect()
    if len(known) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields have limits")
    own = ranges.select("asset", F.lit(field).alias("field"), "low", "high")
    others = ranges.select("asset").distinct().withColumn("f", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(a).alias("low"), F.lit(b).alias("high")) for f, a, b in known if f != field))))
    return others.select("asset", "f.*").unionByName(own)


def canary(values: DataFrame, expected: DataFrame) -> DataFrame:
    """``values`` (asset, value) against ``expected`` (asset, low, high): passed, and deviation from the middle."""
    middle = (F.col("low") + F.col("high")) / 2
    inside = F.col("value").between(F.col("low"), F.col("high"))
    joined = values.join(expected, "asset", "left")
    return joined.withColumns({"passed": F.coalesce(inside, F.lit(False)), "deviation": F.try_divide(F.abs(F.col("value") - middle), middle)})


def daily_health(checks: DataFrame) -> DataFrame:
    """A row for each provider and date of ``checks`` (provider, date, status)."""
    s = F.col("status")
    counted = checks.groupBy("provider", "date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "outlier").alias("outlier"), F.count_if(s == "out_of_range").alias("out_of_range"),
        F.count_if(s.isin("null", "timeout")).alias("missing"), F.count_if(s == "timeout").alias("timeout"), F.every(s == "ok").alias("passed"),
    )
    rate = F.round(F.col("ok") / F.col("total"), 4)
    return counted.withColumn("success_rate", rate).withColumn("healthy", F.col("success_rate") >= HEALTHY)


def provider_health(daily: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """provider, rate, last_date, all_passed, label over the last ``days``."""
    recent = daily.where(F.col("date") > F.date_sub(F.lit(as_of).cast("date"), days))
    out = recent.groupBy("provider").agg(F.avg("success_rate").alias("rate"), F.max("date").alias("last_date"), F.every("passed").alias("all_passed"))
    return out.withColumn("label", F.when(F.col("rate") >= HEALTHY, "OK").when(F.col("rate") >= POOR, "DEGRADED").otherwise("DOWN"))


def status_stats(checks: DataFrame) -> DataFrame:
    """provider, ok, outlier, out_of_range, missing, quality."""
    s = F.col("status")
    out = checks.groupBy("provider").agg(F.count_if(s == "ok").alias("ok"), F.count_if(s == "outlier").alias("outlier"), F.count_if(s == "out_of_range").alias("out_of_range"), F.count_if(s.isin("null", "timeout")).alias("missing"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("quality", F.round(F.col("ok") / F.col("total"), 4)).drop("total")


def best_and_worst(stats: DataFrame, best: int = 3, worst: int = 2) -> DataFrame:
    """The providers of the highest and lowest quality, with side and rank; there is a row for each provider."""
    up, down = Window.orderBy(F.desc("quality"), "provider"), Window.orderBy("quality", F.desc("provider"))
    both = stats.select("provider", "quality", F.row_number().over(up).alias("u"), F.row_number().over(down).alias("d"))
    return both.where(F.col("u") <= best).select("provider", "quality", F.lit("best").alias("side"), F.col("u").alias("rank")).union(both.where(F.col("d") <= worst).select("provider", "quality", F.lit("worst"), F.col("d")))


def top_invalid(checks: DataFrame, n: int = 5) -> DataFrame:
    """The fields with the most checks that aren't ok."""
    return checks.where("status <> 'ok'").groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field").limit(n)


def alerts(daily: DataFrame, open_alerts: DataFrame | None = None) -> DataFrame:
    """provider, date, type, severity that the day's health raises, without those that are open already.

    Values out of range and outliers are failures; a missing value or a timeout is none, it only lowers the share of ok.
    """
    failures = F.col("out_of_range") + F.col("outlier")
    failed = daily.where(failures > 0).select("provider", "date", F.lit("canary_failed").alias("type"), F.when(failures >= FAILURES, "critical").otherwise("warning").alias("severity"))
    low = daily.where(F.col("success_rate") < HEALTHY).select("provider", "date", F.lit("high_outlier_rate").alias("type"), F.when(F.col("success_rate") < POOR, "critical").otherwise("warning").alias("severity"))
    raised = failed.union(low)
    return raised if open_alerts is None else raised.join(open_alerts.select("provider", "type"), ["provider", "type"], "left_anti").select(raised.columns)


def alert_history(daily: DataFrame) -> DataFrame:
    """provider, type, opened, resolved, severity: runs of days on which an alert stands, over a whole history of daily health.

    An alert opens on the first day that raises it. ``canary_failed`` resolves on the first day on which all is ok; the low rate has no
    end of its own. So a run begins where no alert of its kind has stood since the last such day: one window, no loop over days.
    """
    order = Window.partitionBy("provider").orderBy("date")
    cleared = F.col("passed")
    era = F.coalesce(F.sum(cleared.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = daily.withColumns({"era": era, "clear_day": F.min(F.when(cleared, F.col("date"))).over(order.rowsBetween(0, Window.unboundedFollowing))})
    keep = days.select("provider", "date", "era", "clear_day")
    raised = alerts(daily).join(keep, ["provider", "date"])
    failed = ranked(raised.where("type = 'canary_failed'"), ["provider", "era"], [F.col("date")]).select("provider", "type", F.col("date").alias("opened"), F.col("clear_day").alias("resolved"), "severity")
    low = ranked(raised.where("type = 'high_outlier_rate'"), ["provider"], [F.col("date")]).select("provider", "type", F.col("date").alias("opened"), F.lit(None).cast("date").alias("resolved"), "severity")
    return failed.union(low)
