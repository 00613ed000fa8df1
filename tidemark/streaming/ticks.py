"""Structured Streaming over ticks: validation, lateness, minute bars, last values and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bars import ranked
from tidemark.session import scratch_path

LATE, EARLY = "5 minutes", "1 minute"


def parsed(messages: DataFrame, column: str = "json", received: str | None = None) -> DataFrame:
    """asset, ts, price, volume, open, high, low from JSON messages whose keys may be of either case.

    A close or time of 0 counts as absent. The time is under timestamp or time, in seconds since 1970 or as ISO text (UTC where it names no zone); a message without one is of
    the moment it's ``received`` (now). A time or volume that can't be read makes a message null in asset, ts and price, so that ``valid`` drops it; other faulty numbers are null.
    """
    told = lambda name: [F.get_json_object(column, f"$.{n}") for n in (name, name.capitalize())]
    get = lambda name: F.coalesce(*(F.when(~t.isin("", "false"), t) for t in told(name)))
    price = lambda name: F.coalesce(*(F.nullif(t.try_cast("double"), F.lit(0.0)) for t in told(name)))
    time = F.coalesce(*(F.when(F.coalesce(get(n).try_cast("double") != 0, F.lit(True)), get(n)) for n in ("timestamp", "time")))
    at = F.coalesce(F.try_to_timestamp(F.when(time.rlike(r"^\d{4}-\d{2}-\d{2}"), time)), F.timestamp_seconds(time.try_cast("double")))
    now = F.current_timestamp() if received is None else F.lit(received).cast("timestamp")
    volume = get("volume").try_cast("double")
    good = (time.isNull() | at.isNotNull()) & (get("volume").isNull() | volume.isNotNull())
    made = {"asset": get("ticker"), "ts": F.when(time.isNull(), now).otherwise(at), "price": price("close"), "volume": F.coalesce(get("volume").try_cast("bigint"), volume.try_cast("bigint")), **{n: price(n) for n in ("open", "high", "low")}}
    return messages.select(*((F.when(good, c) if n in ("asset", "ts", "price") else c).alias(n) for n, c in made.items()))


def valid(ticks: DataFrame, now: str | None = None) -> DataFrame:
    """Ticks with a price above 0; a negative volume is null. With ``now``, late ones and those of the future are left out."""
    out = ticks.where("price > 0").withColumn("volume", F.when(F.col("volume") >= 0, F.col("volume")))
    if now is not None:
        at = F.lit(now).cast(dict(ticks.dtypes)["ts"]) if now != "now" else F.current_timestamp()
        out = out.where((F.col("ts") <= at + F.expr(f"interval {EARLY}")) & (F.col("ts") >= at - F.expr(f"interval {LATE}")))
    return out


def minute_bars(ticks: DataFrame, width: str = "1 minute") -> DataFrame:
    """Bars by event time; state older than the watermark is dropped."""
    marked = ticks.withWatermark("ts", LATE) if ticks.isStreaming else ticks
    order = F.struct("ts", "event_id") if "event_id" in ticks.columns else F.struct("ts")
    out = marked.groupBy(F.window("ts", width), "asset").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return out.select("asset", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def last_values(ticks: DataFrame) -> DataFrame:
    """Price and time of each asset's newest tick."""
    order = F.struct("ts", "event_id") if "event_id" in ticks.columns else F.struct("ts")
    return ticks.groupBy("asset").agg(F.max_by("price", order).alias("price"), F.max("ts").alias("ts"))


def fresh(values: DataFrame, now: str, seconds: int = 60) -> DataFrame:
    """``values`` (asset, price, ts) that are no older than ``seconds`` at ``now``: a last value past its time to live isn't told."""
    at = F.lit(now).cast(dict(values.dtypes)["ts"])
    return values.where(F.col("ts") > at - F.make_dt_interval(secs=F.lit(seconds)))


def counters(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("asset").agg(F.count(F.lit(1)).alias("tick_count"), F.max("ts").alias("last_tick_at"))


def subscribed(ticks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Ticks of the active ``subscriptions`` (asset, is_active), a static table."""
    return ticks.join(subscriptions.where("is_active").select("asset"), "asset", "left_semi")


def available_now(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What ``stream`` yields for all that is there now. In update mode the newest row of each of ``keys`` counts (last write wins).

    Each batch is written to the shared scratch folder under its number, so a batch that runs again replaces itself.
    """
    spark: SparkSession = stream.sparkSession
    path, schema = scratch_path(spark), stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema(T.StructType([*schema, T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/out/batch=*")
    out = ranked(written, keys, [F.desc("_batch")]) if keys else written
    return out.drop("_batch")
