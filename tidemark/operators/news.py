"""News: canonical addresses, exact and near-equal titles, feed and statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.web import canonical_url

from .bars import ranked

SIMILAR = 0.85
_LEAST = SIMILAR - 1e-9
_BLOCK, _STEP, _MANY, _AT_ONCE = 32, 16, 8, 256
_LONG = 200  # from so many characters on, difflib starts a match at rare characters only
_GRAMS, _MOST = (2, 5), 65535
_WORD, _TOP = np.uint64((1 << 63) - 1), np.uint64(63)
_MARKS = re.compile(r"[^\w\s]")


def exact_dedup(articles: DataFrame, ordinal: str = "ordinal", group: list[str] = ()) -> DataFrame:
    """The first article of each canonical address (within each ``group``); articles without an address stay, each by itself."""
    keyed = articles.withColumn("url_key", canonical_url("url"))
    once = ranked(keyed.where("url_key is not null"), [*group, "url_key"], [F.col(ordinal)])
    return once.unionByName(keyed.where("url_key is null")).drop("url_key")


def _masks(a: str) -> dict[str, int]:
    """The places of each character, as bits."""
    places: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    out = {}
    for c, at in places.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        out[c] = int.from_bytes(bits, "little")
    return out


def _in_common(masks: dict[str, int], size: int, b: str, need: int) -> bool:
    """Whether ``b`` and a text of ``size`` characters, given by its ``masks``, have a common subsequence of ``need`` characters.

    Its length grows by one with each bit that is cleared, a row of the table at once. Characters that are in it stand no further apart than others can be left
    out, so only places near the diagonal count; the end is seen when too many characters of ``b`` have found none.
    """
    left, spare = len(b) - need, size - need
    whole = free = (1 << size) - 1
    for i in range(0, len(b), _BLOCK):
        near = (whole >> max(0, i - left) << max(0, i - left)) & ((1 << max(0, i + _BLOCK + spare)) - 1)
        for c in b[i : i + _BLOCK]:
            met = free & masks.get(c, 0) & near
            free = (free + met) | (free - met)
        free &= whole
        if min(i + _BLOCK, len(b)) - size + free.bit_count() > left:
            return False
    return True


def _in_common_of_many(mine: list[np.ndarray], owner: np.ndarray, others: np.ndarray, at: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which of many texts, ``others`` from ``at`` on, may have a common subsequence of ``need`` characters with their ``owner`` of ``mine``: ``_in_common`` for all at once, a word of 63 places each.

    Characters are told by their lowest eight bits, which only makes more of them equal, and it ends where few are left.
    """
    own = np.array([len(m) for m in mine])
    masks = np.zeros((int(own.max()) // 63 + 1, len(mine) * 257), np.uint64)  # the last column of each is for places after a text's end
    for i, m in enumerate(mine):
        place = np.arange(len(m))
        np.bitwise_or.at(masks, (place // 63, m + np.intp(257 * i)), np.uint64(1) << (place % 63).astype(np.uint64))
    kept, left, spare, first = np.arange(len(at)), sizes - need, own[owner] - need, owner * 257
    free = np.full((len(masks), len(at)), _WORD)
    for i in range(0, int(sizes.max()), _STEP):
        low, high = max(0, i - int(left.max())) // 63, min(len(masks), (i + _STEP + int(spare.max())) // 63 + 1)
        steps = i + np.arange(_STEP)[:, None]
        for c in np.where(steps < sizes, others.take(np.minimum(at + steps, len(others) - 1)), 256) + first:
            for w in range(low, high):
                now = free[w]
                met = masks[w].take(c)
                met &= now
                up = now + met
                if w > low:
                    up += carry  # noqa: F821
                now ^= met
                carry = up >> _TOP
                up &= _WORD
                now |= up
        keep = np.minimum(i + _STEP, sizes) - np.bitwise_count(free ^ _WORD).sum(axis=0, dtype=np.int64) <= left
        if not keep.all():
            kept, at, sizes, left, spare, first, free = kept[keep], at[keep], sizes[keep], left[keep], spare[keep], first[keep], free[:, keep]
            if len(kept) < 2 * len(masks):
                break
    return kept


class _Title:
    """A title as its characters, their counts in 64 classes (a class of several characters only raises what two have in common) and its grams: those that it has as bits, and counts in 512 classes."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.text, self.size, self.wide, self.codes = text, len(codes), codes, codes.astype(np.uint8)
        self.counts = np.minimum(np.bincount(codes & 63, minlength=64), _MOST).astype(np.uint16)
        self.bounds = math.floor(self.size * _LEAST / (2 - _LEAST)), math.ceil(self.size * (2 - _LEAST) / _LEAST)  # of the lengths of titles like it
        self.blocks, self.gram, self._grams = self.size + 1, 0, {}
        if self.size >= _LONG:  # a match holds a rare character, but for one at the start
            often = np.unique(codes, return_counts=True)[1]
            self.blocks = int(often[often <= self.size // 100 + 1].sum()) + 1
            self.gram = int(10 * self.blocks < self.size)

    def grams(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        if gram not in self._grams:
            codes, q = self.wide.astype(np.uint64), _GRAMS[gram]
            n = max(0, len(codes) - q + 1)
            h = np.zeros(n, np.uint64)
            for i in range(q):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += codes[i : i + n]
                h ^= h >> np.uint64(29)
            h = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.intp)
            bits = np.zeros(4096, bool)
            bits[h] = True
            self._grams[gram] = np.packbits(bits).view(np.uint64), np.minimum(np.bincount(h >> 3, minlength=512), _MOST).astype(np.uint16)
        return self._grams[gram]


def _about(size: int) -> int:
    return int(math.log(size + 1) / math.log(1.35))


class _Sized:
    """The entries of about one length, so that a title is held against whole arrays: a row for each class of characters, in the entries' order."""

    def __init__(self) -> None:
        self.n, self.entries, self.sizes, self.counts = 0, np.zeros(16, np.int64), np.zeros(16, np.int32), np.zeros((64, 16), np.uint16)

    def enter(self, entry: int, t: _Title) -> int:
        if self.n == len(self.entries):
            self.entries, self.sizes, self.counts = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.entries, self.sizes, self.counts))
        self.entries[self.n], self.sizes[self.n], self.counts[:, self.n] = entry, t.size, t.counts
        self.n += 1
        return self.n - 1

    def near(self, titles: list[_Title], since: list[int]) -> list[np.ndarray]:
        """For each of ``titles``, which are of about one length, the entries from ``since`` on whose lengths and characters fit."""
        first = int(np.searchsorted(self.entries[: self.n], min(since)))
        entries, sizes, counts = self.entries[first : self.n], self.sizes[first : self.n], self.counts[:, first : self.n]
        bounds = np.array([t.bounds for t in titles])
        fits = (sizes >= bounds[:, :1]) & (sizes <= bounds[:, 1:])
        if bounds.max() <= _MOST and fits.any():
            mine, both = np.stack([t.counts for t in titles], axis=1), np.zeros(fits.shape, np.uint16)
            less = np.empty_like(both)
            for c in np.flatnonzero(mine.any(axis=1)).tolist():
                np.minimum(counts[c], mine[c][:, None], out=less)
                both += less
            fits &= both * np.float32(2 / _LEAST) + np.float32(0.1) >= sizes + np.array([[t.size] for t in titles], np.float32)
        return [entries[f & (entries >= k)] if k > min(since) else entries[f] for f, k in zip(fits, since)]


class TitleSlots:
    """The articles that stay, in the order in which their places were taken; only these are held, and the different titles.

    Two titles are alike from a ratio of ``SIMILAR`` on, which is twice the characters in matching blocks over all of theirs. It is computed only where these bounds,
    told for all places at once, leave it open: (1) lengths; (2) characters that both have; (3) grams of the held title that the other one lacks. Blocks that hold
    ``m`` characters share ``m - blocks * (q - 1)`` grams of ``q`` characters at least; blocks stand apart, so there are no more than unmatched characters and one, and in a
    title of ``_LONG`` characters each but the first starts from a rare one; (4) a common subsequence of as many characters, told for ``_AT_ONCE`` articles together. Equal
    titles have a ratio of 1. A title that came before is held only against what took a place since, and against what was left open or found alike.
    """

    def __init__(self) -> None:
        self.times: list = []
        self.taken: list = []
        self.waiting: list[tuple] = []
        self.held: list[int] = []  # for each place its entry
        self.places: list[int] = []  # for each entry its place, or -1 when another title took it
        self.titles: list[str] = []
        self.sized: dict[int, _Sized] = {}
        self.where: list[tuple[_Sized, int]] = []
        self.known: dict[str, tuple[int, list[int], list[int]]] = {}  # title: the entries it was held against, those left open, those alike
        self.n = self.used = 0
        self.sizes, self.blocks, self.gram, self.at = np.zeros(16, np.int64), np.zeros(16, np.int64), np.zeros(16, np.int8), np.zeros(16, np.int64)
        self.counts, self.bits, self.bags, self.codes = np.zeros((16, 64), np.uint16), np.zeros((16, 64), np.uint64), np.zeros((16, 512), np.uint16), np.zeros(1024, np.uint8)

    @property
    def rows(self) -> list:
        """The rows of all articles that stay."""
        self._settle()
        return self.taken

    def add(self, title: str | None, time, row) -> None:
        """One like an earlier one takes its place if it's newer, else it goes."""
        self.waiting.append((_MARKS.sub("", (title or "").lower()), time, row))
        if len(self.waiting) == _AT_ONCE:
            self._settle()

    def _enter(self, place: int, t: _Title) -> int:
        entry, end = self.n, self.used + t.size
        if entry == len(self.sizes):
            for name in ("sizes", "blocks", "gram", "at", "counts", "bits", "bags"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        if end > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros(max(len(self.codes), t.size), np.uint8)])
        self.codes[self.used : end] = t.codes
        self.sizes[entry], self.blocks[entry], self.gram[entry], self.at[entry] = t.size, t.blocks, t.gram, self.used
        self.bits[entry], self.bags[entry] = t.grams(t.gram)
        self.counts[entry] = t.counts
        alike = self.sized.setdefault(_about(t.size), _Sized())
        self.where.append((alike, alike.enter(entry, t)))
        self.places.append(place)
        self.titles.append(t.text)
        self.n, self.used = entry + 1, end
        return entry

    def _leave(self, entry: int) -> None:
        alike, i = self.where[entry]
        alike.sizes[i] = self.sizes[entry] = self.places[entry] = -1

    def _since(self, t: _Title, since: int) -> np.ndarray:
        """The few entries from ``since`` on whose lengths and characters fit."""
        sizes = self.sizes[since : self.n]
        near = np.flatnonzero((sizes >= t.bounds[0]) & (sizes <= t.bounds[1])) + since
        return near[np.minimum(self.counts.take(near, axis=0), t.counts).sum(axis=1, dtype=np.int64) >= _LEAST / 2 * (self.sizes.take(near) + t.size)] if t.bounds[1] <= _MOST else near

    def _open(self, t: _Title, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those entries of ``near`` that grams leave open for ``t``, the characters they need in common and their blocks."""
        if not len(near):
            return near, near, near
        size, sizes, gram = t.size, self.sizes.take(near), self.gram.take(near)
        need = np.ceil(_LEAST / 2 * (sizes + size)).astype(np.int64)
        blocks = np.minimum(self.blocks.take(near), sizes + size - 2 * need + 1)
        open_ = sizes > _MOST
        for g, q in enumerate(_GRAMS):
            some = np.flatnonzero(gram == g)
            if len(some):
                (bits, bags), shared = t.grams(g), need[some] - blocks[some] * (q - 1)
                lacking = self.bits.take(near[some], axis=0)
                lacking &= ~bits
                fits = np.bitwise_count(lacking).sum(axis=1, dtype=np.int64) + shared <= sizes[some] - q + 1
                some, shared = some[fits], shared[fits]
                open_[some[np.minimum(self.bags.take(near[some], axis=0), bags).sum(axis=1, dtype=np.int64) >= shared]] = True
        return near[open_], need[open_], blocks[open_]

    def _common(self, t: _Title, near: np.ndarray, need: np.ndarray, blocks: np.ndarray) -> list[int]:
        masks, out = None, []
        for e, n, b in zip(near.tolist(), need.tolist(), blocks.tolist()):
            if b == 1 and not self.titles[e].startswith(t.text[:n]):
                continue
            masks = _masks(t.text) if masks is None else masks
            if _in_common(masks, t.size, self.titles[e], n):
                out.append(e)
        return out

    def _settle(self) -> None:
        """Holds the articles that wait against all that stay, and then each in turn against what the others before it changed."""
        waiting, self.waiting = self.waiting, []
        titles = {plain: _Title(plain) for plain, _, _ in waiting}
        groups: dict[tuple, list[_Title]] = {}
        for plain, t in titles.items():
            groups.setdefault((_about(t.size), plain in self.known), []).append(t)
        found: dict[int, list] = {}
        for some in groups.values():
            since = [self.known.get(t.text, (0,))[0] for t in some]
            sized = [self.sized[k].near(some, since) for k in range(_about(min(t.bounds[0] for t in some)), _about(max(t.bounds[1] for t in some)) + 1) if k in self.sized]
            for i, t in enumerate(some):
                near = np.concatenate([x[i] for x in sized]) if sized else np.zeros(0, np.int64)
                found.setdefault(t.size // 63, []).append((t, *self._open(t, near)))
        for words, some in found.items():
            if sum(len(f[1]) for f in some) >= _MANY * (words + 1):  # arrays pay then
                near, need = (np.concatenate([f[i] for f in some]) for i in (1, 2))
                owner = np.repeat(np.arange(len(some)), [len(f[1]) for f in some])
                kept = _in_common_of_many([f[0].codes for f in some], owner, self.codes, self.at.take(near), self.sizes.take(near), need)
                ends, blocks = np.searchsorted(owner[kept], np.arange(len(some) + 1)), np.concatenate([f[3] for f in some])
                some = [(f[0], *(x[kept[ends[i] : ends[i + 1]]] for x in (near, need, blocks))) for i, f in enumerate(some)]
            for t, *open_ in some:
                _, left, alike = self.known.get(t.text, (0, [], []))
                self.known[t.text] = (self.n, left + self._common(t, *open_), alike)
        for plain, time, row in waiting:
            self._place(titles[plain], time, row)

    def _place(self, t: _Title, time, row) -> None:
        since, left, alike = self.known[t.text]
        left = sorted((e for e in left + self._common(t, *self._open(t, self._since(t, since))) if self.places[e] >= 0), key=self.places.__getitem__)
        alike = [e for e in alike if self.places[e] >= 0]
        best, seen = min((self.places[e] for e in alike), default=None), 0
        for e in left:
            if best is not None and self.places[e] > best:
                break
            seen += 1
            if self.titles[e] == t.text or SequenceMatcher(None, t.text, self.titles[e], autojunk=True).ratio() >= SIMILAR:
                best = self.places[e]
                alike.append(e)
                break
        if best is None:
            best = len(self.taken)
            self.held.append(self._enter(best, t))
            self.times.append(time)
            self.taken.append(row)
            alike.append(self.held[best])
        elif time is not None and (self.times[best] is None or time > self.times[best]):
            self.times[best], self.taken[best] = time, row
            old = self.held[best]
            if self.titles[old] != t.text:
                self._leave(old)
                self.held[best] = self._enter(best, t)
                alike = [e for e in alike if e != old] + [self.held[best]]
        self.known[t.text] = (self.n, left[seen:], alike)


def title_dedup(articles: DataFrame, group: list[str], ordinal: str = "ordinal") -> DataFrame:
    """``articles`` without near-equal titles within a ``group``, which is one request: the articles of all providers that answer it.

    Which one stays depends on the order, so a request's articles pass through a task as a sorted stream; what is held are those that stay and the different titles. Groups may have any size;
    bounds told for whole arrays leave few titles to compare. Few groups are dealt over more tasks than there are cores, so that a task has one or none.
    """
    names = articles.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, slots = None, TitleSlots()
        for f in frames:
            done = []
            keys = list(zip(*(f[c].astype(object).where(f[c].notna(), None) for c in group)))
            times = f["published_at"].astype(object).where(f["published_at"].notna(), None).tolist()
            for k, title, time, row in zip(keys, f["title"].tolist(), times, f.itertuples(index=False, name=None)):
                if k != key:
                    done += slots.rows
                    key, slots = k, TitleSlots()
                slots.add(title, time, row)
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame(slots.rows, columns=names)

    spark = articles.sparkSession
    tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return articles.repartition(tasks, *group).sortWithinPartitions(*group, ordinal).mapInPandas(run, articles.schema)


def feed(articles: DataFrame, language: str | None = None, tickers: list[str] | None = None, n: int = 50) -> DataFrame:
    """The newest ``n`` articles; those without a time come first, as in a descending index."""
    out = articles
    if language is not None:
        out = out.where(F.col("language") == language)
    if tickers is not None:
        out = out.where(F.arrays_overlap("tickers", F.array(*map(F.lit, tickers))))
    return out.orderBy(F.col("published_at").desc_nulls_first(), "url").limit(n)


def in_language(language: str) -> Column:
    """Articles of a language, or of none."""
    return F.col("language").isNull() | (F.col("language") == language)


def ticker_news(articles: DataFrame, group: list[str], language: str | None = None, n: int = 20) -> DataFrame:
    """What is told for each ticker and fetch: the language is chosen first, then repeated addresses and near-equal titles go, then the newest ``n`` stay."""
    out = articles if language is None else articles.where(in_language(language))
    return ranked(title_dedup(exact_dedup(out, "ordinal", group), group), group, [F.col("published_at").desc_nulls_last(), F.col("ordinal")], n)


def counts(articles: DataFrame) -> DataFrame:
    """kind, name, n, latest by provider and by language."""
    both = [articles.groupBy(F.lit(k).alias("kind"), F.col(k).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("published_at").alias("latest")) for k in ("provider", "language")]
    return both[0].union(both[1])


def top_tickers(articles: DataFrame, n: int = 10) -> DataFrame:
    return articles.select(F.explode(F.array_distinct("tickers")).alias("ticker")).groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ticker").limit(n)
