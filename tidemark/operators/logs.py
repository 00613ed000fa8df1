"""Figures of usage and ingest logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_log(logs: DataFrame) -> DataFrame:
    """ticker, log_id, created_at, status of each ticker's newest row; the larger log_id wins a tie."""
    newest = logs.groupBy("ticker").agg(F.max_by(F.struct("log_id", "created_at", "status"), F.struct("created_at", "log_id")).alias("r"))
    return newest.select("ticker", "r.*")


def inventory(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Rows and their first and last time for each ``key``."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def with_latest_log(inventoried: DataFrame, logs: DataFrame) -> DataFrame:
    """``inventoried`` (ticker, ...) with its last status: one join, not a query for each ticker."""
    return inventoried.join(latest_log(logs).select("ticker", F.col("status").alias("last_status")), "ticker", "left")


def by_endpoint(logs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return logs.where(F.col("created_at") > F.expr(f"timestamp_ntz'{as_of}' - interval {int(hours)} hours")).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


def top_tickers(logs: DataFrame, as_of: str, hours: int = 24, n: int = 5) -> DataFrame:
    recent = logs.where(F.col("created_at") > F.expr(f"timestamp_ntz'{as_of}' - interval {int(hours)} hours"))
    return recent.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ticker").limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    counted = [t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, t in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.union(c)
    return out


USAGE = ["created_at", "endpoint", "method", "status_code", "latency_ms", "provider_used", "cache_hit"]


def append_usage(rows: DataFrame, path: str) -> None:
    """Adds requests (USAGE) to the usage log, by day."""
    rows.select(*USAGE, F.to_date("created_at").alias("day")).repartitionByRange("day", "created_at").write.mode("append").partitionBy("day").parquet(path)


def newest(rows: DataFrame, time: str, tie: str, n: int = 50) -> DataFrame:
    """The ``n`` newest rows, the larger ``tie`` first among equals."""
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(n)


def known_names(*catalogs: DataFrame) -> DataFrame:
    """The different names (name) that any of ``catalogs`` has."""
    out = catalogs[0].select("name")
    for c in catalogs[1:]:
        out = out.union(c.select("name"))
    return out.distinct()
