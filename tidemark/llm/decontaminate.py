r"""Benchmark decontamination by winnowing.

A k-gram hash is kept where it is the smallest of a sliding window of hashes. With k = 5 words and windows of 9 hashes,
any 13 words that a document and an item share have the same smallest hash on both sides, so joining the kept hashes
finds every shared span of 13 words or more; a hit is extended to the windows of 13 words around it, which are compared
word by word. Items of fewer words than that have no such guarantee. Each is one window, looked up by its first word.

A benchmark of at most ``BLOCK_WORDS`` words (counted first) is broadcast as one index, and no document text is shuffled. A larger one never
reaches the driver or a task as a whole: its kept hashes and its windows are tables. Documents' distinct kept hashes are joined with the former, and the windows of the
texts that share one with the latter, by 128-bit digests of words' hashes. Items of fewer words take part with their one window. Equal texts
are joined once; no step gathers more than one text's rows under a key, and joins of frequent hashes can be split.

Null texts have no words. Items without words have no windows. Rows of the benchmark with the same item_id
count as one item; those with a null item_id hit documents but aren't listed. Documents that repeat are handled row by
row. An empty benchmark hits nothing. Columns of the documents that the result names too are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

from .sieve import sieved
from .texts import alnum_words, map_texts, table

K, WINDOW = 5, 9
SPAN = K + WINDOW - 1
BLOCK_WORDS, SEED = 200_000, 42
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)  # odd numbers, one for each word of a k-gram


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def smallest_hashes(ids: np.ndarray) -> np.ndarray:
    """The smallest k-gram hash of each window of ``SPAN`` words."""
    m = _mixed(ids.astype(np.uint64))
    n = len(ids) - K + 1
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h += m[j : j + n] * _MULTIPLIERS[j]
    h = _mixed(h)
    width = 1
    while width < WINDOW:  # minima of windows twice as wide each time
        step = min(width, WINDOW - width)
        h = np.minimum(h[: len(h) - step], h[step:])
        width += step
    return h


class BlockIndex:
    """The windows of a block of items, and their kept hashes."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.names = list(dict.fromkeys(name for name, _ in items))
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[bytes, set[int]] = {}
        self.short: dict[int, dict[bytes, set[int]]] = {}
        kept = [np.zeros(0, np.uint64)]
        for name, text in items:
            words = alnum_words(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
            if len(ids) < SPAN:
                self.short.setdefault(len(ids), {}).setdefault(ids.tobytes(), set()).add(number[name])
                continue
            for s in range(len(ids) - SPAN + 1):
                self.windows.setdefault(ids[s : s + SPAN].tobytes(), set()).add(number[name])
            kept.append(smallest_hashes(ids))
        self.kept = np.unique(np.concatenate(kept))
        self.first = {}
        for n, spans in self.short.items():
            self.first[n] = np.zeros(len(self.vocabulary) + 1, bool)
            self.first[n][[np.frombuffer(x, np.int32)[0] for x in spans]] = True

    def scan(self, words: list[bytes], hit: np.ndarray) -> set[str | None]:
        """Marks the words that stand in a window; returns the items whose windows occur."""
        known = self.vocabulary.get
        ids = np.array([known(w, 0) for w in words], np.int32)
        found: set[int] = set()
        seen: set[bytes] = set()

        def look(starts: np.ndarray, length: int, spans: dict[bytes, set[int]]) -> None:
            for s in starts.tolist():
                key = ids[s : s + length].tobytes()
                if key in spans:
                    hit[s : s + length] = True
                    if key not in seen:
                        seen.add(key)
                        found.update(spans[key])

        if len(ids) >= SPAN and len(self.kept):
            h = smallest_hashes(ids)
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))  # a kept hash holds for a run of windows
            at = np.minimum(np.searchsorted(self.kept, h[new]), len(self.kept) - 1)
            met = np.flatnonzero(self.kept[at] == h[new])
            if len(met):
                ends = np.append(new[1:], len(h))
                for i in met.tolist():
                    look(np.arange(new[i], ends[i]), SPAN, self.windows)
        for n, spans in self.short.items():
            if len(ids) >= n:
                look(np.flatnonzero(self.first[n][ids[: len(ids) - n + 1]]), n, spans)
        return {self.names[i] for i in found}


_INDEXES: dict[str, BlockIndex] = {}


def _index(name: str, items: list[tuple[str | None, bytes]]) -> BlockIndex:
    """One index is kept in each worker, under the name that its broadcast was given."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = BlockIndex(items)
    return _INDEXES[name]


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _broadcast_hits(documents: DataFrame, items: DataFrame, keep: list[str] | None) -> DataFrame:
    rows = [(r["name"], bytes(r["text"])) for r in items.select("name", F.col("text").cast("binary").alias("text")).where("octet_length(text) > 0").collect()]
    name, block = uuid.uuid4().hex, documents.sparkSession.sparkContext.broadcast(rows)

    def scan(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        index = _index(name, block.value)
        for text in texts:
            words = alnum_words(text or b"")
            hit = np.zeros(len(words), bool)
            found = index.scan(words, hit) if words else set()
            yield len(words), int(hit.sum()), sorted(x for x in found if x is not None), _spans(hit) if found else []

    return map_texts(documents, scan, RESULT, keep)


class _Words:
    """64-bit hashes of words, remembered up to a bound."""

    REMEMBERED = 200_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        known = self.known
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w, SEED)
            out[i] = h
        return out


def _windows(ids: np.ndarray, n: int) -> list[bytes]:
    raw = ids.astype("<u8").tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * i : 8 * (i + n)], n) for i in range(len(ids) - n + 1)]


def _hash_of(window: bytes) -> int:
    return int.from_bytes(window[:8], "big", signed=True)


def _kept(ids: np.ndarray, lengths: list[int]) -> list[int]:
    """Distinct kept hashes of a text, and those of its windows of ``lengths`` words."""
    found = set(np.unique(smallest_hashes(ids)).view(np.int64).tolist()) if len(ids) >= SPAN else set()
    for n in lengths:
        found.update(map(_hash_of, _windows(ids, n)))
    return list(found)


def _item_windows(texts: Iterator[bytes | None]) -> Iterator[tuple]:
    make = _Words()
    for t in texts:
        ids = make.ids(alnum_words(t or b""))
        n = min(SPAN, len(ids))
        yield n, _kept(ids, [n] if 0 < n < SPAN else []), list(set(_windows(ids, n))) if n else []


def _classes(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows (w, class) and classes (class, name): windows of the same items are of one class, so that a place is one row however many items share it.

    A class is named by the number and two mergeable digests of its items, so no window's items are gathered in one task.
    """
    of = [F.xxhash64(F.lit(k), F.col("name").isNull(), F.coalesce("name", F.lit(""))) for k in (1, 2, 3)]
    classes = materialise(windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(of[:2])), F.sum(of[2].cast("decimal(38,0)")).alias("s")).select("w", F.struct("n", "x0", "x1", "s").alias("class")))
    one = classes.groupBy("class").agg(F.min("w").alias("w"))
    return classes, materialise(windows.join(one, "w").select("class", "name"))


def _joined_hits(documents: DataFrame, items: DataFrame, keep: list[str] | None) -> DataFrame:
    made = materialise(map_texts(items, _item_windows, "n int, hashes array<long>, windows array<binary>", ["name"]))
    lengths = sorted(r["n"] for r in made.where(f"n between 1 and {SPAN - 1}").select("n").distinct().collect())
    hashes = made.select(F.explode("hashes").alias("h")).distinct()
    classes, members = _classes(made.select("name", F.explode("windows").alias("w")).distinct())

    def keys(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        make = _Words()
        for t in texts:
            yield (_kept(make.ids(alnum_words(t or b"")), lengths),)

    def places(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        make = _Words()
        for t in texts:
            ids = make.ids(alnum_words(t or b""))
            yield ([{"start": i, "end": i + n, "w": w} for n in [*lengths, SPAN] for i, w in enumerate(_windows(ids, n))],)

    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    texts = documents.select(key.alias("_key"), "text")
    met = materialise(map_texts(texts, keys, "hashes array<long>", ["_key"]).select("_key", F.explode("hashes").alias("h")).join(hashes, "h", "left_semi").select("_key"))
    met = materialise(met.distinct())
    maybe, _ = sieved(texts, "_key", met)  # most texts share no hash with an item and aren't shuffled
    matched = maybe.join(met, "_key", "left_semi").groupBy("_key").agg(F.first("text").alias("text"))
    found = map_texts(matched, places, "places array<struct<start:long,end:long,w:binary>>", ["_key"]).select("_key", F.inline("places"))
    hits = materialise(found.join(classes, "w").select("_key", "start", "end", "class"))

    def add(state, p):
        """Joins a place to the last span if they touch; places come by their starts."""
        last = F.element_at(state, -1)
        longer = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], p["end"]).alias("end"))))
        return F.when((F.size(state) > 0) & (p["start"] <= F.try_element_at(state, F.lit(-1))["end"]), longer).otherwise(F.concat(state, F.array(p)))

    spans = F.aggregate("places", F.array().cast("array<struct<start:long,end:long>>"), add)
    items_of = hits.select("_key", "class").distinct().join(members, "class").groupBy("_key").agg(F.array_sort(F.collect_set("name")).alias("items"))
    places_of = hits.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("places"))
    of_text = materialise(places_of.join(items_of, "_key", "left").select("_key", F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans")))

    def counted(rows: DataFrame) -> DataFrame:
        return map_texts(rows, lambda texts: ((len(alnum_words(t or b"")),) for t in texts), "n_words long", None if keep is None else [*keep, "_key"]).drop("n_hit", "items", "spans")

    maybe, never = sieved(documents.withColumn("_key", key), "_key", of_text.select("_key"))
    nothing = [F.lit(None).cast(of_text.schema[c].dataType).alias(c) for c in ("items", "spans")]
    counted = counted(maybe).join(of_text, "_key", "left").unionByName(counted(never).select("*", *nothing)).drop("_key")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))
    nothing = {c: F.coalesce(c, F.array().cast(of_text.schema[c].dataType)) for c in ("items", "spans")}
    return counted.withColumn("n_hit", n_hit).withColumns(nothing).select(*(c for c in counted.columns if c not in ("items", "spans", "n_words")), "n_words", "n_hit", "items", "spans")


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` with n_words, n_hit, items (ids sorted as strings) and spans (runs of hit words, end exclusive)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text")
    words = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]  # no text has more words
    return (_broadcast_hits if words <= block_words else _joined_hits)(documents, items, keep)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """True where a twentieth of the words or more are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones; the columns stay as they are."""
    found = benchmark_hits(documents.withColumnsRenamed({c: f"in_{c}" for c in documents.columns if c != "text"}), benchmark)
    kept = found.where(~contaminated())
    return kept.select(*(F.col("text") if c == "text" else F.col(f"in_{c}").alias(c) for c in documents.columns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.sha2(F.concat_ws(",", "items"), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), contaminated().alias("contaminated"))


OP2_SQL = r"""
with d as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
n as (select item, w, least(13, len(w)) as n from i where len(w) > 0),
iw as (
  select distinct item, n, array_to_string(w[s : s + n - 1], ' ') as win
  from (select item, w, n, unnest(range(1, len(w) - n + 2)) as s from n)),
lengths as (select distinct n from n),
dw as (
  select k, n, s, array_to_string(w[s : s + n - 1], ' ') as win
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lengths where len(w) >= n)),
hits as (select distinct k, dw.n, s, item from dw join iw on dw.n = iw.n and dw.win = iw.win),
words as (select k, count(distinct p) as n_hit from (select k, unnest(range(s, s + n)) as p from hits) group by k),
items as (select k, count(distinct item) as n_items, sha256(array_to_string(list_sort(list(distinct item)), ',')) as sha from hits group by k)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (k) left join items using (k)
"""
