"""Maps the driver's tables onto the engine's inputs: ticks, bars, assets, statements, logs, news."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, a scan of files, dealt over all cores: a file of few bytes may hold very many pages' numbers, and reading a page costs more than moving its row.

    A scan's partitions don't tell where its rows are: a file is cut by bytes, but all rows of a row group are read with one cut, so most of many partitions can be empty.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, rows.rdd.getNumPartitions()))


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of ticks."""
    schema = read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return e.select("event_id", F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").try_cast("bigint").alias("volume"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, asset, ts, price, volume: a tick for each row of ``events``."""
    e = read(spark, sf_dir, "events")
    volume = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.select("event_id", F.col("event_type").alias("asset"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), volume.alias("volume"))


def intraday_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """asset, ts, open, high, low, close, volume of each ``unit``; ``ts`` of ticks is unique, so first and last are certain."""
    t = ticks(spark, sf_dir).withColumn("bar", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    return t.groupBy("asset", F.col("bar").alias("ts")).agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close"),
        F.sum("volume").alias("volume"),
    )


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each part brand: price is extendedprice / quantity, ordered within a day by the line's columns."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("p_brand").alias("asset"),
        F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("k"),
    )
    return rows.groupBy("asset", "ts").agg(
        F.min_by("price", "k").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "k").alias("close"),
        F.sum("volume").alias("volume"),
    )
