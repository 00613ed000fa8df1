"""Queries over logs: orders stand for log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import logs as op
from tidemark.sources.adapters import read

LOGS = "select o_orderkey as log_id, o_custkey as ticker, cast(o_orderdate as timestamp) as created_at, o_orderstatus as status, o_orderpriority as endpoint from orders"
AS_OF, HOURS = "2001-06-01 00:00:00", 24 * 60


def logs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("log_id"), F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("endpoint"))


_SINCE = f"created_at > timestamp '{AS_OF}' - interval {HOURS} hours"
_TABLES = ["orders", "customer", "events"]
QUERIES = {
    "latest_log_per_ticker": (lambda spark, d: op.latest_log(logs(spark, d)), f"with l as ({LOGS}) select ticker, log_id, created_at, status from l qualify row_number() over (partition by ticker order by created_at desc, log_id desc) = 1"),
    "ticker_inventory": (
        lambda spark, d: op.with_latest_log(op.inventory(logs(spark, d), "ticker", "created_at"), logs(spark, d)),
        f"with l as ({LOGS}) select ticker, count(*) as n, min(created_at) as first, max(created_at) as last, arg_max(status, row(created_at, log_id)) as last_status from l group by 1",
    ),
    "usage_by_endpoint": (lambda spark, d: op.by_endpoint(logs(spark, d), AS_OF, HOURS), f"with l as ({LOGS}) select endpoint, count(*) as n from l where {_SINCE} group by 1"),
    "top_tickers": (lambda spark, d: op.top_tickers(logs(spark, d), AS_OF, HOURS), f"with l as ({LOGS}) select ticker, count(*) as n from l where {_SINCE} group by 1 order by n desc, ticker limit 5"),
    "table_counts": (lambda spark, d: op.table_counts({t: read(spark, d, t) for t in _TABLES}), " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in _TABLES)),
}
