r"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is its rate: the whole part is taken of every document, and the rest is the inclusion
probability of one copy more. The cube method's flight moves these probabilities through the null space of two
constraints, the source's expected documents and words, until each is 0 or 1: three undecided documents at a time have a
direction that changes neither total, and a step along it decides one of them. So a stream of documents needs three of each
source in memory. Large documents go first, and the few smallest of each source are held back.

The flight runs over chunks of a source of about ``BLOCK_ROWS`` documents, dealt by a hash of their ids, so that a source with most rows is spread over
many tasks and any number of small sources over all tasks. A chunk leaves ``HELD`` documents and two at most undecided; those of a source meet again in the next flight, in fewer chunks.
A source that fits into one chunk is landed there: of its last ``LANDING`` documents and two the few largest are tried in all ways, the others fill up
what is missing, and the way that comes closest to the source's expected words is taken.
Chunks, orders and random draws come from hashes of the rows, so reruns agree whatever the partitions.

Sources are ranked for their weights by a range partitioning, and the common level of the targets is found from sums over buckets of sources of like capacity,
then among the different capacities of one bucket, so no task gets a row for every source.

Null texts and texts without words have size 0; they take part and take no words; very long ones are counted whole. A null source is a source of its
own, the last. Equal rows are drawn one by one, and rows of equal id and size share their draw's hash, not their decision. Sources of size 0 have target 0. Extra columns are left
out of ``mix``; ``mixed_documents`` keeps them and replaces those named copies and taken. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

from .texts import blank_words, map_texts, table

WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK_ROWS, SEED, FEW = 10_000, 2024, 10_000
HELD, LANDING, TRIED = 4, 24, 4
_EPS = 1e-9


def _ranked(summed: DataFrame) -> DataFrame:
    """``summed`` with place, from 0 by code points of source, null last."""
    parts = summed.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    parts = materialise(parts)
    counts = parts.groupBy("_part").count()
    offsets = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("place", (F.col("_own") + F.col("_before") - 1).cast("long")).drop("_part", "_own", "_before")


def common_level(rows: DataFrame, words: float) -> float | None:
    """The level l at which the sum of least(most, l * w) over ``rows`` (most, w) is ``words``; None if the sum of most doesn't reach it.

    The different ratios of most to w are summed in buckets of a 64th of an octave, of which some thousand exist; only the bucket in which the level
    lies is looked at ratio by ratio.
    """
    ratios = rows.where("most > 0").groupBy((F.col("most") / F.col("w")).alias("r")).agg(F.sum("most").alias("m"), F.sum("w").alias("w"))
    ratios = materialise(ratios.withColumn("bucket", F.floor(F.log2("r") * 64).cast("int")))
    before, rest = 0.0, ratios.agg(F.sum("w")).first()[0] or 0.0
    for b in ratios.groupBy("bucket").agg(F.max("r").alias("r"), F.sum("m").alias("m"), F.sum("w").alias("w")).orderBy("bucket").collect():
        if before + b["m"] + b["r"] * (rest - b["w"]) >= words * (1 - _EPS):
            up_to = Window.orderBy("r")
            earlier = up_to.rowsBetween(Window.unboundedPreceding, -1)
            inside = ratios.where(F.col("bucket") == b["bucket"]).select("r", "m", "w", (F.coalesce(F.sum("m").over(earlier), F.lit(0.0)) + before).alias("m0"), (F.lit(rest) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))).alias("w0"))
            first = inside.where(F.col("m0") + F.col("r") * F.col("w0") >= words * (1 - _EPS)).orderBy("r").first()
            return (words - first["m0"]) / first["w0"] if first else None
        before, rest = before + b["m"], rest - b["w"]
    return None


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target for each source of ``sizes`` (source, size).

    ``share`` of all words are dealt by weight; a target stops at ``cap`` times its source and the excess goes to the others, so a target is the
    least of its cap and the common level times its weight.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialise(_ranked(summed).withColumn("w", weight).withColumn("most", F.lit(cap) * F.col("source_size")))
    level = common_level(rows, share * (rows.agg(F.sum("source_size")).first()[0] or 0))
    return rows.select("source", "source_size", (F.col("most") if level is None else F.least("most", F.lit(level) * F.col("w"))).alias("target"))


def _unit(*parts) -> float:
    """A number in (0, 1) from the parts, the same everywhere."""
    x = SEED
    for p in parts:
        x = ((x ^ (int(p) & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
    return ((x >> 11) + 0.5) / (1 << 53)


def direction(a: float, b: float, c: float) -> tuple[float, float, float]:
    """A move of three probabilities that keeps their sum and the expected words, given their sizes."""
    return (1.0, -1.0, 0.0) if a == b == c else (b - c, c - a, a - b)


def flight_step(pool: list[list], draw: float) -> None:
    """Moves the first three of ``pool`` ([probability, size, ...]) until one is decided; in expectation none moves."""
    u = direction(pool[0][1], pool[1][1], pool[2][1])
    up = down = math.inf
    for x, d in zip(pool, u, strict=False):
        if d > 0:
            up, down = min(up, (1 - x[0]) / d), min(down, x[0] / d)
        elif d < 0:
            up, down = min(up, x[0] / -d), min(down, (1 - x[0]) / -d)
    step = up if draw * (up + down) < down else -down
    for x, d in zip(pool, u, strict=False):
        x[0] += step * d
        if x[0] < _EPS:
            x[0] = 0.0
        elif x[0] > 1 - _EPS:
            x[0] = 1.0


def landed(pool: list[list]) -> None:
    """Decides the rest of a source so that its words come closest to their expectation."""
    words = sum(x[0] * x[1] for x in pool)
    pool.sort(key=lambda x: -x[1])
    best = None
    for c in range(1 << min(TRIED, len(pool))):
        taken, left = [], words
        for i, x in enumerate(pool):
            take = c >> i & 1 if i < TRIED else x[1] <= left + 0.5
            taken.append(float(take))
            left -= x[1] * taken[-1]
        if best is None or abs(left) < best[0]:
            best = abs(left), taken
    for x, p in zip(pool, best[1], strict=True):
        x[0] = p


def _flight(rows: DataFrame) -> DataFrame:
    """``rows`` (chunk, whole, source, h, doc_id, size, p) with p moved; rows of a chunk come together, the largest first, and a whole source is landed."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pool, held, landing, done = None, [], deque(), False, []

        def close() -> None:
            pool.extend(held)
            held.clear()
            if landing:
                landed(pool)
            done.extend(pool)
            pool.clear()

        for f in frames:
            for chunk, whole, source, h, doc, size, p in zip(*(f[c].tolist() for c in ("chunk", "whole", "source", "h", "doc_id", "size", "p")), strict=True):
                if (chunk, source) != at:
                    close()
                    at, landing = (chunk, source), whole
                held.append([p, float(size), chunk, whole, source, h, doc, size])
                if len(held) > (LANDING if whole else HELD):
                    pool.append(held.popleft())
                if len(pool) == 3:
                    flight_step(pool, _unit(chunk, h, size))
                    done.extend(y for y in pool if y[0] in (0.0, 1.0))
                    pool[:] = [y for y in pool if 0.0 < y[0] < 1.0]
            yield frame(done)
            done.clear()
        close()
        yield frame(done)

    def frame(done: list[list]) -> pd.DataFrame:
        made = pd.DataFrame([(*x[2:8], x[0]) for x in done], columns=["chunk", "whole", "source", "h", "doc_id", "size", "p"])
        return made.astype({"chunk": "int64", "whole": "bool", "h": "int64", "size": "int64", "p": "float64"})[names]

    sorted_rows = rows.repartition("chunk").sortWithinPartitions("chunk", "source", F.desc("size"), "h", "doc_id")
    return sorted_rows.mapInPandas(run, rows.schema)


def _by_source(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their source in ``table``, which is broadcast if it has few rows."""
    named = table.select(F.col("source").alias("_s"), *columns)
    return rows.join(F.broadcast(named) if table.count() <= FEW else named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def balanced_sample(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (doc_id, source, size, p; perhaps h, a hash that tells them apart) with p decided: 0 or 1, the documents and words of each source near to their expectation."""
    kind = dict(rows.dtypes)["doc_id"]
    h = F.col("h") if "h" in rows.columns else F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size")
    given = materialise(rows.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "p", h.alias("h")))
    names, open_ = given.columns, F.col("p").between(_EPS, 1 - _EPS)
    out = given.where(~open_)
    now, salt = given.where(open_), 0
    while True:
        counts = materialise(now.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("chunks")))
        if counts.isEmpty():
            break
        salt += 1  # chunks of one flight mix those of the flight before
        placed = _by_source(now, counts, ["chunks"])
        chunk = F.xxhash64(F.lit(salt), "source", F.pmod(F.xxhash64("h", F.lit(salt)), F.col("chunks")))
        flown = materialise(_flight(placed.select(*names, chunk.alias("chunk"), (F.col("chunks") == 1).alias("whole"))))
        out = out.unionByName(flown.where(~open_).select(*names))
        now = flown.where(open_).select(*names)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).drop("h")


def mix(documents: DataFrame, row: str = "doc_id", h: str | None = None) -> DataFrame:
    """row, source, size, source_size, target, copies (how often the mix takes the document) and taken (words).

    ``row`` names the column that tells documents apart in the result, ``h`` one with a hash of theirs; by default the doc_id, of which there may be several.
    """
    sizes = materialise(map_texts(documents, lambda texts: ((len(blank_words(t or b"")),) for t in texts), "size long", [row, "source", *([h] if h else [])]))
    targets = materialise(source_targets(sizes))
    joined = _by_source(sizes, targets, ["source_size", "target"])
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(rate + _EPS)
    split = F.greatest(F.lit(0.0), rate - whole)
    p = F.when(split < _EPS, 0.0).otherwise(split)
    open_ = joined.select(F.col(row).alias("doc_id"), "source", "size", p.alias("p"), *([F.col(h).alias("h")] if h else []))
    back = _by_source(balanced_sample(open_), targets, ["source_size", "target"])
    copies = (whole + F.col("p")).cast("long")
    return back.select(F.col("doc_id").alias(row), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes at least once, with copies and taken, row by row: rows without a doc_id or with the same one are drawn each by itself.

    Rows are told apart by a number that is written with them, and drawn by a hash of all their columns (but maps), so reruns draw the same rows however they are partitioned.
    """
    given = documents.drop("copies", "taken")
    told = [x for c, t in given.dtypes if "map<" not in t for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    rows = materialise(given.withColumns({"__row": F.monotonically_increasing_id(), "__h": F.xxhash64(F.lit(SEED), *told)}))
    drawn = mix(rows, "__row", "__h").where("copies > 0").select("__row", "copies", "taken")
    return rows.drop("__h").join(drawn, "__row").drop("__row")


def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
