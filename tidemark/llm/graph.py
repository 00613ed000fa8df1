"""Connected components of an edge table by alternating large-star and small-star steps.

A large-star step links each node's larger neighbours to its smallest neighbour, a small-star step its smaller ones; neither adds
edges, so the table never grows, and the number of steps grows with the logarithm of the nodes. Every step is a partial
aggregation and a join that Spark can split where a node has very many edges, written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def connected(edges: DataFrame) -> DataFrame:
    """node, root for each node of ``edges`` (u, v) that isn't a root; root is the smallest node it can reach. Null ends and loops are ignored."""
    pairs = edges.where("u is not null and v is not null and u <> v")
    now = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, _state(now)
    while state[0] and state != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct()
        now = materialise(small)
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
