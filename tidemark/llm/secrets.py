r"""Secret scans by grammar inference.

Base patterns find credentials by their surroundings or shape. Their values are labelled credentials: for each label a prefix tree of a
sample is folded into a probabilistic automaton by merging states whose outgoing frequencies agree within
Hoeffding's bound (red states are kept, blue ones are merged into a red one or turn red). Every run of ``LEAST`` or more token characters
is a candidate, of whatever letters or digits, and so is the value of each base span. A candidate's format likelihood is the log2 ratio of
its probability under an automaton and under the background, which is the table of pairs of character classes over all texts outside base spans. It is a secret where
the mean per symbol reaches that of nearly all labelled values held out from the fit and the sum reaches ``BITS``. A run that overlaps a base
span keeps the pieces beside it. A piece that isn't a secret as a whole is scored without the signs around it, then in parts between signs.

Texts are read twice: for the labelled values and the background, then for the scores. The sample (``SAMPLE`` whole values for each label, those of the
smallest hashes, of ``CHARACTERS`` characters in all) and the table of pairs are all that reaches the driver. Labels of fewer than ``FEWEST`` values aren't learned.

Base spans keep their place and have the best label and its score, whatever it is. Learnt spans never overlap base spans. Of labels
of equal score the last by name is told. Null and empty texts have no spans; very long ones are scanned whole. Rows are told one by one, so repeated rows give
repeated results. Without labelled values nothing is learnt and base spans stand alone, without scores. An empty table gives an empty
result. Columns that aren't kept are left out, and kept ones named spans, learnt or n_candidates are replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

from .texts import map_texts, table

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
LEARNT = "learnt"
LEAST, SAMPLE, CHARACTERS, FEWEST, HELD_OUT, ALPHA, MISSED, BITS = 8, 400, 100_000, 8, 4, 0.05, 0.02, 20.0
RESULT = "spans array<struct<kind:string,start:long,end:long,value:string,label:string,score:double>>, learnt array<struct<start:long,end:long,value:string,label:string,score:double>>, n_candidates long"

#: Classes of token characters from 1 on: digits, hex letters a-f, other letters a-z, A-F, other letters A-Z, and each sign; 0 is what stands between tokens.
_CLASSES = [b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"+", b"/", b"_", b".", b"=", b"-"]
_CLASS = bytes(next((i + 1 for i, x in enumerate(_CLASSES) if c in x), 0) for c in range(256))
_SIGNS = bytes(range(6, len(_CLASSES) + 1))
ALPHABET = len(_CLASSES) + 1  # and the end
_RUN = re.compile(rb"[^\x00]{%d,}" % LEAST)
_PART = re.compile(rb"[\x01-\x05]{%d,}" % LEAST)


def base_spans(text: bytes) -> list[tuple[str, int, int, bytes]]:
    """kind, start, end (bytes) and value of the base matches, by kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if b":" in text or b"=" in text else []
    if b"AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]


def symbols(value: str | bytes) -> bytes:
    """The class of each character."""
    return (value.encode() if isinstance(value, str) else value).translate(_CLASS)


class Background:
    """Log2-probabilities of a class after a class, 0 being the start and the end of a token; uniform without counts."""

    def __init__(self, pairs: dict[int, int] | None = None):
        counts = np.zeros((ALPHABET, ALPHABET))
        for pair, n in (pairs or {}).items():
            counts[pair // ALPHABET, pair % ALPHABET] = n
        counts[0, 0] = 0
        self.log = np.log2((counts + 1) / (counts + 1).sum(axis=1, keepdims=True)).tolist()


class Automaton:
    """A prefix tree of strings of classes, folded by merges of states that look alike."""

    def __init__(self, strings: list[bytes], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [defaultdict(int)]
        self.ends: list[int] = [0]
        for s in strings:
            at = 0
            for c in s:
                if c not in self.next[at]:
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.ends.append(0)
                    self.next[at][c] = len(self.next) - 1
                self.count[at][c] += 1
                at = self.next[at][c]
            self.ends[at] += 1
        self.margin = math.sqrt(0.5 * math.log(2 / alpha))
        red, kept = [0], {0}
        while True:
            blue = [(r, c) for r in red for c, t in sorted(self.next[r].items()) if t not in kept]
            if not blue:
                break
            parent, c = max(blue, key=lambda x: (self.total(self.next[x[0]][x[1]]), x[1]))
            state = self.next[parent][c]
            twin = next((r for r in red if self.alike(r, state)), None)
            if twin is None:
                red.append(state)
                kept.add(state)
            else:
                self.next[parent][c] = twin
                self.fold(twin, state)
        self._pack(red)

    def total(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.margin * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def alike(self, a: int, b: int) -> bool:
        """Frequencies agree here and below; ``b`` is the root of a tree, so the walk ends."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            if self.differ(self.ends[a], n, self.ends[b], m) or any(self.differ(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m) for c in self.count[a].keys() | self.count[b].keys()):
                return False
            todo.extend((self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys())
        return True

    def fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _pack(self, red: list[int]) -> None:
        """Tables over the states that are left: the next state (-1: none) and the log2-probability of each class, 0 being the end; unseen ones keep a small share."""
        number = {s: i for i, s in enumerate(red)}
        self.to = [[number.get(self.next[s].get(c, -1), -1) for c in range(ALPHABET)] for s in red]
        self.log = [[math.log2(((self.ends[s] if c == 0 else self.count[s].get(c, 0)) + 0.1) / (self.total(s) + 0.1 * ALPHABET)) for c in range(ALPHABET)] for s in red]
        del self.next, self.count, self.ends

    def score(self, s: bytes, background: Background | None = None) -> float:
        """Mean log2-likelihood ratio per symbol, the end included. Where the automaton has no way on, the rest can only lower it."""
        against = (background or _UNIFORM).log
        at, before, bits = 0, 0, 0.0
        for c in (*s, 0):
            other = against[before][c]
            if at >= 0:
                bits += self.log[at][c] - other
                at = self.to[at][c]
            else:
                bits += min(0.0, _EVEN - other)
            before = c
        return bits / (len(s) + 1)


_UNIFORM, _EVEN = Background(), -math.log2(ALPHABET)


def fit(values: dict[str, list[str]], background: Background | None = None) -> dict[str, tuple[Automaton, float]]:
    """For each label an automaton and the score that a candidate must reach: that of all but ``MISSED`` of the values held out."""
    models = {}
    for label, found in sorted(values.items()):
        strings = [symbols(v) for v in sorted(set(found))]
        if len(strings) < FEWEST:
            continue
        model = Automaton([s for i, s in enumerate(strings) if i % HELD_OUT])
        held = sorted(model.score(s, background) for i, s in enumerate(strings) if i % HELD_OUT == 0)
        models[label] = model, max(0.0, held[int(MISSED * len(held))])
    return models


class Scorer:
    """Scores strings of classes under all automata. Results are remembered, up to a bound."""

    REMEMBERED, LONGEST = 200_000, 64

    def __init__(self, models: dict[str, tuple[Automaton, float]], background: Background):
        self.models, self.background = models, background
        self.known: dict[bytes, tuple[float | None, str | None, bool]] = {}

    def best(self, s: bytes) -> tuple[float | None, str | None, bool]:
        """Score, label, and whether it is a secret; of labels that accept it the best, else the best of all."""
        found = self.known.get(s)
        if found is None:
            scores = [(model.score(s, self.background), label, least) for label, (model, least) in self.models.items()]
            told = [(x >= least and x * (len(s) + 1) >= BITS, x, label) for x, label, least in scores]
            good, x, label = max(told, default=(False, None, None))
            found = x, label, good
            if len(s) <= self.LONGEST:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                self.known[s] = found
        return found

    def learnt(self, s: bytes) -> Iterator[tuple[int, int, float, str]]:
        """start, end, score and label of the secrets in a candidate: the whole, or without the signs around it, or its parts."""
        score, label, good = self.best(s)
        if good:
            yield 0, len(s), score, label
            return
        bare = s.strip(_SIGNS)
        if len(bare) == len(s) and not any(c in s for c in _SIGNS):
            return
        lead = len(s) - len(s.lstrip(_SIGNS))
        if LEAST <= len(bare) < len(s):
            score, label, good = self.best(bare)
            if good:
                yield lead, lead + len(bare), score, label
                return
        for m in _PART.finditer(s):
            if m.end() - m.start() < len(bare):
                score, label, good = self.best(m[0])
                if good:
                    yield m.start(), m.end(), score, label


def pieces(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What ``taken`` (sorted) leaves of a run, in pieces of at least LEAST characters."""
    for a, b in taken:
        if b > start and a < end:
            if a - start >= LEAST:
                yield start, a
            start = max(start, b)
    if end - start >= LEAST:
        yield start, end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _code_points(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Offsets in bytes (between characters) to offsets in code points."""
    out, at, n = {}, 0, 0
    for x in sorted(set(offsets)):
        n += len(text[at:x].decode())
        out[x], at = n, x
    return out


def scan(text: bytes | None, scorer: Scorer) -> tuple[list[dict], list[dict], int]:
    if not text:
        return [], [], 0
    base = base_spans(text)
    taken = _merged([(a, b) for _, a, b, _ in base])
    classes = text.translate(_CLASS)
    told, learnt, n, first = [], [], len(base), 0
    for kind, a, b, value in base:
        score, label, _ = scorer.best(symbols(value))
        told.append((kind, a, b, value, label, score))
    for m in _RUN.finditer(classes):
        start, end = m.span()
        while first < len(taken) and taken[first][1] <= start:
            first += 1
        last = first
        while last < len(taken) and taken[last][0] < end:
            last += 1
        for a, b in pieces(start, end, taken[first:last]) if last > first else ((start, end),):
            n += 1
            learnt += [(a + x, a + y, text[a + x : a + y], label, score) for x, y, score, label in scorer.learnt(classes[a:b])]
    at = _code_points(text, [x for s in told for x in s[1:3]] + [x for s in learnt for x in s[:2]])
    return (
        [{"kind": k, "start": at[a], "end": at[b], "value": v.decode(), "label": label, "score": s} for k, a, b, v, label, s in told],
        [{"start": at[a], "end": at[b], "value": v.decode(), "label": label, "score": s} for a, b, v, label, s in learnt],
        n,
    )


def _survey(texts: Iterator[bytes | None]) -> Iterator[tuple]:
    """Labelled values of a text, and how often a class follows another one outside base spans."""
    for t in texts:
        t = t or b""
        base = base_spans(t)
        codes = np.frombuffer(b"\0" + t.translate(_CLASS) + b"\0", np.uint8).astype(np.int64)
        for _, a, b, _ in base:
            codes[a + 1 : b + 1] = 0
        pairs = np.bincount(codes[:-1] * ALPHABET + codes[1:], minlength=ALPHABET * ALPHABET)
        met = np.flatnonzero(pairs)
        yield [{"kind": k, "value": v.decode()} for k, _, _, v in base], [{"pair": int(p), "n": int(n)} for p, n in zip(met, pairs[met], strict=True) if p]


def labelled_values(values: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> dict[str, list[str]]:
    """At most ``sample`` different whole values of each kind of ``values`` (kind, value), those of the smallest hashes; one that would bring a kind's values above ``characters`` is passed over.

    So what the driver gets, and the prefix tree that it builds of it, has a bound, however long a value is. No value is cut.
    """
    different = materialise(values.where(F.length("value") >= LEAST).distinct().select("kind", "value", F.xxhash64("value").alias("h")))
    out: dict[str, list[str]] = {}
    for kind in KINDS:
        rows = different.where(F.col("kind") == kind)
        left, chosen = characters, []
        for r in rows.select("h", F.length("value").alias("n")).orderBy("h", "n").limit(sample).collect():
            if r["n"] <= left:
                left -= r["n"]
                chosen.append(r["h"])
        if chosen:
            out[kind] = [r["value"] for r in rows.where(F.col("h").isin(chosen) & (F.length("value") <= characters)).orderBy("h", "value").limit(sample).collect()]
    return out


def find_secrets(documents: DataFrame, keep: list[str], labelled: dict[str, list[str]] | None = None) -> DataFrame:
    """``keep`` columns, spans (base), learnt and n_candidates (how many strings were scored) of each document.

    ``labelled`` has credentials by label; where it isn't given, the base values of these documents are taken.
    """
    seen = materialise(map_texts(documents, _survey, "values array<struct<kind:string,value:string>>, pairs array<struct<pair:int,n:long>>", ["text"]).select("values", "pairs"))
    counted = seen.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n")).collect()  # a row for each pair of classes
    background = Background({r["pair"]: r["n"] for r in counted})
    models = fit(labelled_values(seen.select(F.explode("values").alias("v")).select("v.*")) if labelled is None else labelled, background)
    shared = documents.sparkSession.sparkContext.broadcast((models, background))

    def run(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        scorer = Scorer(*shared.value)
        for t in texts:
            yield scan(t, scorer)

    return map_texts(documents, run, RESULT, keep)


def op9_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    rank = lambda s: F.element_at(F.create_map(*(x for i, k in enumerate([*KINDS, LEARNT]) for x in (F.lit(k), F.lit(i)))), s)
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    more = F.transform("learnt", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.lit(LEARNT).alias("kind")))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    scores = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["label"], F.round(s["score"], 3).cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, more)).alias("spans"), F.size("learnt").cast("long").alias("n_learnt"), "n_candidates", scores.alias("base_scores"))


def _of(kind: str):
    return lambda s: s["kind"] == kind
