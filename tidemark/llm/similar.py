r"""Near-duplicates by the similarity (Jaccard) of whole texts' sets of five-word shingles: links of at least 4/5, and their components.

Texts of equal words collapse into one key first. The SimHash operator then proposes links: fingerprints of the same shingles at most four bits apart, by
multi-index hashing, each text held against the first of its component. Its radius reaches few pairs of similarity 0.8, so bands complete it. Minima of ``BANDS * ROWS`` hashes over a text's shingles are cut into bands, and texts that
share a band are candidates: a pair of similarity s shares none with probability (1 - s**ROWS) ** BANDS, which is 1.3e-7 at 0.8 and 7e-11 at 0.85.
Every candidate link is verified on the sets themselves, so no pair below 4/5 is linked. Only texts that share a band, or that fingerprints propose, get their sets written; a proposal counts whether its texts share a band or not.

A band of many near copies would meet in full, so its texts are first held against one of them, a few times with another one, and linked texts
take a common root; the first one is that which meets most texts, as the middle of a group does. The texts of bands that still hold different roots are then
joined exactly by prefixes: a text's shingles are ordered from rare to common (among these texts), and two sets of similarity 4/5 share one of the first fifth of each.
A pair also has to be able to reach 4/5 by the sizes and by the shingles behind the shared one, so a copy with many changes of its own meets
nobody. Pairs of a common root aren't compared: of two roots that share a shingle one isn't its commonest, so the texts of the others are held against all.

Texts without words are copies of each other; very long ones are hashed whole. Columns besides doc_id and text aren't read, whatever their names. Documents of a null doc_id get the smallest id that they reach, or null. Repeated rows
and equal ids are told row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

from .graph import connected
from .sieve import sieved
from .simhash import fingerprint_components, fingerprint_of, one_of_each, shingle_digests
from .texts import map_texts

SHINGLE, SEED = 5, 42
BANDS, ROWS, ROUNDS = 40, 5, 2
_AT_ONCE = 1 << 11
_DRAWS = np.random.default_rng(SEED)
_FACTOR = _DRAWS.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSET = _DRAWS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: bytes | None) -> np.ndarray:
    """Different 64-bit hashes of the shingles, sorted; a text of fewer words is a shingle of its own."""
    return _different(list(shingle_digests(text, SHINGLE)))


def _different(digests: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(digests).view(">u8").astype(np.uint64).ravel()) if digests else np.zeros(0, np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of minima; none for a text without shingles."""
    if not len(hashes):
        return []
    x, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _AT_ONCE):
        np.minimum(least, (x[i : i + _AT_ONCE, None] * _FACTOR + _OFFSET).min(axis=0), out=least)
    raw, width = least.astype("<u4").tobytes(), 4 * ROWS
    return [int.from_bytes(xxhash.xxh64_digest(raw[i * width : (i + 1) * width], i), "big", signed=True) for i in range(BANDS)]


def _key(text: bytes | None) -> int:
    return int.from_bytes(xxhash.xxh64_digest(b" ".join((text or b"").lower().split()), SEED), "big", signed=True)


def _keys(texts: Iterator[bytes | None]) -> Iterator[tuple]:
    for t in texts:
        yield (_key(t),)


def _signatures(texts: Iterator[bytes | None]) -> Iterator[tuple]:
    for t in texts:
        digests = list(shingle_digests(t, SHINGLE))
        found = _different(digests)
        yield _key(t), len(found), fingerprint_of(digests), bands(found)


def _sets(texts: Iterator[bytes | None]) -> Iterator[tuple]:
    for t in texts:
        yield (shingles(t).view(np.int64),)


def _near(m: str, n: str) -> Column:
    """Sets of ``m`` and ``n`` elements can have a similarity of 4/5."""
    return 5 * F.least(m, n) >= 4 * F.greatest(m, n)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose sets (key, hashes) have a similarity of at least 4/5."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb")), "b")
    return both.where(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))).drop("ha", "hb")


def _size_bucket(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(1.05)).cast("int")


def prefixes(live: DataFrame, sets: DataFrame) -> DataFrame:
    """key, n, root, h, at: the shingles of the prefix of each key of ``live`` (key, n, root) that another key has too; at is its place from rare to common, from 0."""
    elements = sets.join(live.select("key"), "key", "left_semi").select("key", F.explode("hashes").alias("h"))
    again = materialise(elements.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = elements.join(again, "h")
    own = Window.partitionBy("key")
    placed = shared.select("key", "h", F.row_number().over(own.orderBy("df", "h")).alias("k"), F.count(F.lit(1)).over(own).alias("support"))
    return placed.join(live, "key").select("key", "n", "root", "h", (F.col("n") - F.col("support") + F.col("k") - 1).alias("at")).where("5 * (n - at) >= 4 * n")


def prefix_pairs(entries: DataFrame) -> DataFrame:
    """a, ra, b, rb: the pairs of different roots that share an entry of ``entries`` (``prefixes``) and can reach 4/5."""
    most = entries.groupBy("h", "root").count().groupBy("h").agg(F.max(F.struct("count", "root")).alias("x")).select("h", F.col("x.root").alias("most"))
    most = materialise(most)
    # Of two texts of similarity 4/5 the overlap is 4/9 of the sizes, and after their first common shingle each has to have as many left.
    reach = F.sequence(_size_bucket(F.ceil(F.col("n") * 4 / 5)), _size_bucket(F.greatest(F.ceil(F.col("n") * 4 / 5), F.floor((F.col("n") - F.col("at")) * 9 / 4 - F.col("n")))))
    others = entries.join(most, "h").where("root <> most").select("h", F.explode(reach).alias("bucket"), F.col("key").alias("a"), F.col("n").alias("na"), F.col("at").alias("i"), F.col("root").alias("ra"))
    alls = entries.select("h", _size_bucket(F.col("n")).alias("bucket"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("at").alias("j"), F.col("root").alias("rb"))
    met = others.join(alls, ["h", "bucket"]).where("ra <> rb and 9 * least(na - i, nb - j) >= 4 * (na + nb)")
    return met.select("a", "ra", "b", "rb").distinct()


def _rerooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the roots that ``links`` (ra, rb) lead to."""
    moved = connected(links.select(F.col("ra").alias("u"), F.col("rb").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return rows.join(moved, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to").select(*rows.columns)


def _hub(i: int) -> Column:
    """The key of a band that the others are held against in round ``i``: first the one that meets most, later those of a hash's order."""
    return F.min(F.struct((-F.col("meets") if i == 0 else F.xxhash64(F.lit(i), "key")).alias("o"), "key", "n", "root"))


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """a, ra, b, rb: each key of ``texts`` (key, n, fp) and the first key of the fingerprint that its own one leads to."""
    fps = materialise(texts.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "n")).alias("first")))
    rooted = materialise(fingerprint_components(fps.select("fp", "n")))
    named = materialise(rooted.join(fps.select(F.col("fp").alias("root"), "first"), "root").select("fp", F.col("first.key").alias("b"), F.col("first.n").alias("nb")))
    met = texts.join(named, "fp").where((F.col("key") != F.col("b")) & _near("n", "nb"))
    return met.select(F.col("key").alias("a"), F.col("key").alias("ra"), "b", F.col("b").alias("rb"))


def roots(entries: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, root for each key of ``entries`` (key, n, band, size: keys of the band), whose bands have two keys at least, and of ``pairs`` (a, ra, b, rb).

    ``sets`` has the shingles of each; ``pairs`` are held against each other first, whether they share a band or not.
    """
    met = entries.select("key", "size").unionByName(_keys_of(pairs).withColumn("size", F.lit(0).cast("long")))
    known = met.groupBy("key").agg(F.sum("size").alias("meets")).select("key", F.col("key").alias("root"), "meets")
    known = materialise(_rerooted(known, materialise(verified(pairs, sets).select("ra", "rb"))))
    live = entries
    for i in range(ROUNDS + 1):
        live = live.select("key", "n", "band").join(known, "key")
        mixed = materialise(live.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), _hub(i).alias("c")).where("lo <> hi"))  # written, so that the join can split a band with most of the keys
        live = materialise(live.join(mixed.select("band", F.col("c.key").alias("b"), F.col("c.n").alias("nb"), F.col("c.root").alias("rb")), "band"))
        if live.isEmpty():
            break
        if i < ROUNDS:
            met = live.where((F.col("root") != F.col("rb")) & _near("n", "nb")).groupBy(F.col("key").alias("a"), F.col("root").alias("ra"), "b", "rb").count()
            pairs = met.groupBy("a", "ra").agg(F.max(F.struct("count", "b", "rb")).alias("x")).select("a", "ra", "x.b", "x.rb")
        else:
            pairs = prefix_pairs(materialise(prefixes(live.select("key", "n", "root").distinct(), sets)))
        known = materialise(_rerooted(known, materialise(verified(pairs, sets).select("ra", "rb"))))
    return known.select("key", "root")


def _keys_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key"))


def similar_components(documents: DataFrame) -> DataFrame:
    """doc_id, component_id for each row of ``documents`` (doc_id, text): the smallest doc_id it reaches by links of similarity 4/5 or more."""
    return components_of(documents, materialise(map_texts(documents, _signatures, "key long, n int, fp long, bands array<long>", ["doc_id"])))


def components_of(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``similar_components`` by ``rows`` (doc_id, key, n, fp, bands), the signatures of ``documents``."""
    firsts = materialise(rows.groupBy("key", "n", "fp").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")))
    entries = firsts.select("key", "n", F.explode("bands").alias("band"))
    shared = materialise(entries.join(entries.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "band"))
    proposed = materialise(fingerprint_pairs(firsts))
    wanted = materialise(shared.select("key").union(_keys_of(proposed)).distinct())
    maybe, _ = sieved(map_texts(documents, _keys, "key long", ["text"]), "key", wanted)  # most texts needn't be shuffled
    texts = maybe.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key", "left_semi")  # copies meet before the shuffle
    sets = materialise(map_texts(texts, _sets, "hashes array<long>", ["key"]))
    named = firsts.select("key", "first").join(roots(shared, sets, proposed), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    named = materialise(named)
    least = materialise(named.groupBy("root").agg(F.min("first").alias("component_id")))  # written, so that the join can split a root with most of the keys
    return rows.select("doc_id", "key").join(named.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def similar_dedup(documents: DataFrame) -> DataFrame:
    """``documents`` with one document of each component by similarity, that of the smallest doc_id."""
    return one_of_each(documents, materialise(similar_components(documents)))
