"""Stored bars: a parquet table laid out by time partitions that is changed in place, partition by partition.

Parquet has no MERGE. ``upsert_stored`` reads only the partitions that the new rows fall into, writes their new content to a staging folder inside the table (hidden from readers by its
underscore), marks it complete, and then puts each staged partition in the place of the old one. A crash before the mark leaves the table as it was; after it, the next call
(or ``recover``) finishes the moves. As an upsert by key is idempotent, a batch that runs again changes nothing. Other partitions' files are never touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import upsert

STAGING, COMPLETE = "_staging", "_complete"
MONTH, DAY = "yyyy-MM", "yyyy-MM-dd"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def recover(spark: SparkSession, path: str) -> None:
    """Finishes the moves of a complete staging folder, and deletes one that isn't complete."""
    for batch in _folders(spark, f"{path}/{STAGING}"):
        fs, staged = _fs(spark, f"{path}/{STAGING}/{batch}")
        if fs.exists(_fs(spark, f"{path}/{STAGING}/{batch}/{COMPLETE}")[1]):
            for part in (n for n in _folders(spark, f"{path}/{STAGING}/{batch}") if "=" in n):
                target = _fs(spark, f"{path}/{part}")[1]
                fs.delete(target, True)
                if not fs.rename(_fs(spark, f"{path}/{STAGING}/{batch}/{part}")[1], target):
                    raise OSError(f"could not move {part} of {batch}")
        fs.delete(staged, True)


def _laid_out(rows: DataFrame, time: str, unit: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.date_format(time, unit))


def upsert_stored(path: str, new: DataFrame, keys: list[str], time: str = "ts", update: list[str] | None = None, unit: str = MONTH, name: str = "month", finish: bool = True) -> list[str]:
    """Writes the rows of ``new``, unique by ``keys`` (``time`` is one of them), into the table at ``path``; of known keys the ``update`` columns (or all) are replaced. Returns the partitions it wrote.

    Rows without ``time`` have no place and are refused. ``finish=False`` stops after the mark, as a crash would.
    """
    spark = new.sparkSession
    recover(spark, path)
    placed = _laid_out(new, time, unit, name)
    touched = [r[0] for r in placed.select(name).distinct().collect()]  # a row for each partition
    if None in touched:
        raise ValueError(f"rows without {time}")
    if not touched:
        return []
    merged = placed
    if [p for p in _folders(spark, path) if p.startswith(f"{name}=")]:
        have = spark.read.schema(placed.schema).option("basePath", path).parquet(path).where(F.col(name).isin(touched))
        merged = upsert(have, placed, [*keys, name], None if update is None else update)
    batch = f"{path}/{STAGING}/{uuid.uuid4().hex}"
    merged.repartitionByRange(name, *(k for k in keys if k != time)).sortWithinPartitions(name, *keys).write.partitionBy(name).parquet(batch)
    fs, mark = _fs(spark, f"{batch}/{COMPLETE}")
    fs.create(mark).close()
    if finish:
        recover(spark, path)
    return sorted(touched)


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table at ``path``, whose time partition is a string."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("basePath", path).parquet(path)


def drop_before(spark: SparkSession, path: str, first: str, name: str = "day") -> list[str]:
    """Deletes whole time partitions before ``first`` by their folders' names alone: no file of them is read, no file of others rewritten. Returns what went.

    A table's values are kept for whole units; what a cut inside a unit would leave out is for the reader's filter.
    """
    old = [p for p in _folders(spark, path) if p.startswith(f"{name}=") and p.split("=", 1)[1] < first]
    for p in old:
        fs, folder = _fs(spark, f"{path}/{p}")
        fs.delete(folder, True)
    return old


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, time: str = "ts", unit: str = DAY, name: str = "day", keep_days: int | None = None, mode: str = "update"):
    """Starts a query that upserts each batch of ``stream`` into the table at ``path`` and, with ``keep_days``, drops partitions that are older than so many days before the newest one."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            upsert_stored(path, batch, keys, time, unit=unit, name=name)
        finally:
            batch.unpersist()
        days = [p.split("=", 1)[1] for p in _folders(spark, path) if p.startswith(f"{name}=")]
        if keep_days is not None and days:
            first = spark.sql(f"select date_format(date_sub(to_date('{max(days)}'), {int(keep_days)}), '{unit}')").first()[0]
            drop_before(spark, path, first, name)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


