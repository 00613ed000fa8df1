r"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints of at most ``radius`` differing bits have a segment i that differs in at most
r_i bits if the sum of r_i + 1 over the segments exceeds ``radius`` (pigeonhole), so each fingerprint looks up the
Hamming balls of radius r_i around its segments in tables of the others' segments, and whole distances are checked in the join.
Two values that differ in two bits share a neighbour one bit from each, so a ball of radius 2 is put half on each side: w + 1 rows of both
in place of 1 + w + w(w-1)/2 of one. Flipped bits are numbered, and a pair meets in a segment at most once: at the centre of its larger one, or by the lower bit of its smaller one.
Three segments serve up to ``WIDE`` different fingerprints and two beyond, where three would meet too many strangers; both are exact.

Exact copies collapse into one fingerprint first. A group of many near copies would still meet in full, so each segment's
bucket is first linked to its commonest fingerprint, which gives a link to each member at most; the join
then leaves out pairs that these links have already put into one component. That loses no link between components.

Null and empty texts have the fingerprint zero and are linked like any other; very long ones are hashed whole. Columns besides doc_id and text
aren't read, whatever their names, and ``one_of_each`` keeps them. Documents of a null doc_id get the smallest id
that they reach, or null. Repeated rows and equal ids are told row by row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

from .graph import connected
from .sieve import sieved
from .texts import map_texts, table

SHINGLE, RADIUS, SEED, WIDE = 4, 4, 42, 1 << 27
_AT_ONCE = 1 << 15


def shingle_digests(text: bytes | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, repeats included, in order: arrays of (shingles, 8) bytes, the first byte the highest."""
    words = (text or b"").lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    for i in range(0, n, _AT_ONCE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _AT_ONCE], ends[i : i + _AT_ONCE], strict=True)])
        yield np.frombuffer(hashes, np.uint8).reshape(-1, 8)


def fingerprint_of(digests: Iterable[np.ndarray]) -> int:
    """Signed 64 bits: a bit is set if it is in over half the digests."""
    n, counts = 0, np.zeros(64, np.int64)
    for d in digests:
        n += len(d)
        counts += np.unpackbits(d, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return fingerprint_of(shingle_digests(text, shingle))


def fingerprints(documents: DataFrame, keep: list[str], shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``keep`` columns and fp, the fingerprint of each whole text."""

    def run(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        for t in texts:
            yield (fingerprint(t, shingle),)

    return map_texts(documents, run, "fp long", keep, text)


def segments(count: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """Shift, width and ball radius of each segment. Their widths differ by the size of their balls."""
    m = 3 if count < WIDE else 2
    rest = max(0, radius + 1 - m)
    radii = [rest // m + (i < rest % m) for i in range(m)]
    widths = [64 // m + (r > min(radii)) for r in radii]
    widths[-1] += 64 - sum(widths)
    return [(sum(widths[:i]), w, r) for i, (w, r) in enumerate(zip(widths, radii, strict=True))]


def _key(number: int, shift: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1).bitwiseOR(number << 40)


def _looked(parts: list[tuple[int, int, int]], stored: bool) -> Column:
    """One row (key, bit) for each place where a fingerprint looks, or is ``stored``: bit is 0 for its own segment and else the number of the flipped bit."""
    sides = []
    for i, (shift, width, radius) in enumerate(parts):
        mine = radius // 2 if stored else radius - radius // 2
        if mine > 1:
            raise ValueError("segments hold balls of radius 2 at most")
        masks = [(0, 0), *((1 << b, b + 1) for b in range(width) if mine)]
        sides += [F.struct(_key(i, shift, width).bitwiseXOR(F.lit(m).cast("long")).alias("key"), F.lit(b).alias("bit")) for m, b in masks]
    return F.inline(F.array(*sides))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and root (the smallest fingerprint it reaches) for each row of ``fps`` (different fp, n: how many documents have it)."""
    parts = segments(fps.count(), radius)
    tables = F.explode(F.array(*(_key(i, s, w) for i, (s, w, _) in enumerate(parts))))
    entries = fps.select("fp", "n", tables.alias("key"))
    centres = entries.groupBy("key").agg(F.max_by("fp", F.struct("n", "fp")).alias("centre"))
    stars = entries.join(centres, "key").where((F.col("fp") != F.col("centre")) & (_distance("fp", "centre") <= radius))
    roots = connected(stars.select(F.col("fp").alias("u"), F.col("centre").alias("v")))
    known = materialise(fps.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    probes = known.select(F.col("fp").alias("a"), F.col("root").alias("ra"), _looked(parts, stored=False)).withColumnRenamed("bit", "bit_a")
    stored = known.select(F.col("fp").alias("b"), F.col("root").alias("rb"), _looked(parts, stored=True)).withColumnRenamed("bit", "bit_b")
    once = (F.col("bit_b") == 0) | (F.col("bit_a") > 0) & (F.col("bit_a") < F.col("bit_b"))
    found = probes.join(stored, "key").where((F.col("a") < F.col("b")) & once & (F.col("ra") != F.col("rb")) & (_distance("a", "b") <= radius))
    links = connected(found.select(F.col("ra").alias("u"), F.col("rb").alias("v")))
    links = links.select(F.col("node").alias("r1"), F.col("root").alias("r2"))
    return known.join(links, known["root"] == links["r1"], "left").select("fp", F.coalesce("r2", "root").alias("root"))


def components(fingerprinted: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row of ``fingerprinted`` (doc_id, fp): the smallest doc_id it reaches by links of at most ``radius`` bits."""
    rows = materialise(fingerprinted.select("doc_id", "fp"))
    fps = materialise(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    rooted = materialise(fingerprint_components(fps, radius).join(fps.select("fp", "first"), "fp"))
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")))  # written, so that the join can split a root with most fingerprints
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame, grouped: DataFrame) -> DataFrame:
    """``documents`` with one document of each component of ``grouped`` (doc_id, component_id), that of the smallest doc_id; rows without a doc_id stay, and of rows that share one the first by text (then by all columns as JSON) stays."""
    gone = grouped.where("doc_id <> component_id").select("doc_id").distinct()
    gone = materialise(gone)
    maybe, never = sieved(documents, "doc_id", gone)  # most texts needn't be shuffled
    left = never.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*documents.columns))
    repeated = materialise(grouped.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*documents.columns)))).alias("row")).select("row.*")
    return left.join(repeated, "doc_id", "left_anti").select(*documents.columns).union(once)


def near_dedup(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``documents`` with one document of each component by fingerprints."""
    return one_of_each(documents, materialise(components(fingerprints(documents, ["doc_id"], shingle), radius)))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
