"""A sieve of fixed size, that spares rows a shuffle: a bitmap of hashes of some keys tells which rows can't have one of them.

It has ``BITS`` bits, 4 MB, whatever the keys, so it can be broadcast. With very many keys it lets all rows through, which costs the shuffle and no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

BITS, BUCKET = 1 << 25, 1 << 15  # a bucket is what bitmap_construct_agg makes


def sieved(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``column`` may be in ``keys`` (one column), and the rest of them, in which none is. Both have the columns of ``rows``."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    placed = keys.select(place(F.col(keys.columns[0]).cast(dict(rows.dtypes)[column])).alias("p"))
    bits = materialise(placed.groupBy(F.floor(F.col("p") / BUCKET).alias("__bucket")).agg(F.bitmap_construct_agg(F.col("p") % BUCKET).alias("__bits")))
    marked = rows.withColumn("__place", place(F.col(column))).withColumn("__of", F.floor(F.col("__place") / BUCKET))
    joined = marked.join(F.broadcast(bits), F.col("__of") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__place") % BUCKET / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    possible = F.coalesce(F.getbit(byte, (F.col("__place") % 8).cast("int")) == 1, F.lit(False))
    return tuple(joined.where(c).select(*(f"`{n}`" for n in rows.columns)) for c in (possible, ~possible))
