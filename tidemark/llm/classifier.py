r"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Each feature i has a weight w_i and a vector v_i of ``FACTORS`` numbers; a document's score is the logistic function of
w_0 + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j. The pairs take linear time by the identity
2 * sum of pairs = |sum v_i x_i|^2 - sum |v_i x_i|^2.

Features are the words (hashed, damped counts of unit length), and structure and metadata (n_chars) as one-hot steps. Labels, language, source
and doc_id are never features. The fit takes at most ``MAX_TRAIN`` labelled documents, those of the smallest hashes of their ids,
and never one held out; their features are all that reaches the driver. Scoring is one pass over whole texts with the weights broadcast:
``BUCKETS`` + a few hundred features, whatever the corpus.

Null and empty texts have no words and are scored by their structure. Null labels aren't used, nor are labels without a doc_id; of
several labels of a document the largest counts, and of several rows of a labelled doc_id the first by text is learned from; each row is scored by itself. Very long texts are read
whole. Columns that aren't kept are left out, and one named score is replaced; text and n_chars have to be there. A null doc_id isn't held out. Where labels of one kind alone are known every score is
their share; without labels it is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import WHITESPACE, alnum_words, blank_words, map_texts, table

BUCKETS, FACTORS, MAX_TRAIN, EPOCHS, BATCH = 1 << 15, 8, 6000, 8, 128
RATE, DECAY, SEED, THRESHOLD = 0.3, 1e-5, 7, 0.3
AT_ONCE = 1 << 14  # features that are scored together
_STEPS = 16
_UPPER, _DIGITS, _SYMBOLS, _STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>", b".,;:!?"
STATISTICS = ["words", "word length", "upper", "digits", "symbols", "stops", "other words", "repeated lines", "line length", "beyond ascii", "first words", "n_chars"]
FEATURES = BUCKETS + _STEPS * len(STATISTICS)


def _share_step(share: float) -> int:
    """0 for none, then steps that double from 1/1024 to the whole."""
    return 0 if share <= 0 else max(1, min(_STEPS - 1, 12 + math.ceil(math.log2(share))))


def _size_step(n: float) -> int:
    return min(_STEPS - 1, int(math.log2(n + 1)))


def statistics(text: bytes, words: list[bytes], chars: int) -> list[int]:
    """A step for each of STATISTICS."""
    n = max(1, len(text))
    count = lambda kind: len(text) - len(text.translate(None, kind))
    blanks = blank_words(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ascii_only = text.translate(None, bytes(range(128, 256)))
    return [
        _size_step(len(blanks)),
        min(_STEPS - 1, round((len(text) - count(WHITESPACE)) / max(1, len(blanks)))),
        _share_step(count(_UPPER) / n),
        _share_step(count(_DIGITS) / n),
        _share_step(count(_SYMBOLS) / max(1, len(blanks))),
        _share_step(count(_STOPS) / max(1, len(blanks))),
        _share_step(len(set(words)) / max(1, len(words))),
        _share_step((len(lines) - len(set(lines))) / max(1, len(lines))),
        _size_step(len(blanks) / max(1, len(lines))),
        _share_step((len(text) - len(ascii_only)) / n),
        _size_step(len(lines)),
        _size_step(chars),
    ]


class Featuriser:
    """Sparse vectors of texts. Hashes of words are remembered, up to a bound."""

    REMEMBERED = 200_000

    def __init__(self) -> None:
        self.bucket: dict[bytes, int] = {}

    def vector(self, text: bytes | None, chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or b""
        words = alnum_words(text)
        counts = Counter(words)
        if len(self.bucket) > self.REMEMBERED:
            self.bucket.clear()
        bucket = self.bucket
        index = []
        for w in counts:
            b = bucket.get(w)
            if b is None:
                b = bucket[w] = zlib.crc32(w) % BUCKETS
            index.append(b)
        value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        if len(value):
            value /= math.sqrt(float(value @ value))
        steps = statistics(text, words, len(text) if chars is None else chars)
        at = [BUCKETS + _STEPS * i + s for i, s in enumerate(steps)]
        return np.array(index + at, np.int64), np.concatenate((value, np.full(len(at), 1 / math.sqrt(len(at)))))


class FactorisationMachine:
    def __init__(self, bias: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.bias = bias
        self.w = np.zeros(FEATURES) if w is None else w
        self.v = np.random.default_rng(SEED).normal(0, 0.05, (FEATURES, FACTORS)) if v is None else v

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.w[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        """Scores of some vectors, none of them empty, in one go over their features."""
        index, value = (np.concatenate([x[i] for x in vectors]) for i in (0, 1))
        starts = np.cumsum([0, *(len(x[0]) for x in vectors[:-1])])
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        raw = self.bias + np.add.reduceat(self.w[index] * value, starts) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
        return (1 / (1 + np.exp(-np.clip(raw, -35, 35)))).tolist()

    @classmethod
    def fit(cls, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> FactorisationMachine:
        """Logistic loss by AdaGrad over batches, in a fixed order."""
        share = float(labels.mean()) if len(labels) else 0.5
        if share in (0.0, 1.0) or not len(labels):
            return cls(0.0 if not len(labels) else 35.0 if share else -35.0, v=np.zeros((FEATURES, FACTORS)))
        m = cls(math.log(share / (1 - share)))
        past_w, past_v, past_b = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6), 1e-6
        random = np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            for batch in np.array_split(random.permutation(len(vectors)), max(1, len(vectors) // BATCH)):
                index = np.concatenate([vectors[i][0] for i in batch])
                value = np.concatenate([vectors[i][1] for i in batch])
                sizes = np.array([len(vectors[i][0]) for i in batch])
                starts, row = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(batch)), sizes)
                vx = m.v[index] * value[:, None]
                total = np.add.reduceat(vx, starts, axis=0)
                raw = m.bias + np.add.reduceat(m.w[index] * value, starts) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat(vx * vx, starts, axis=0).sum(axis=1))
                slope = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[batch]) / len(batch)
                used, where = np.unique(index, return_inverse=True)
                grad_w = np.bincount(where, slope[row] * value, len(used)) + DECAY * m.w[used]
                each = slope[row][:, None] * value[:, None] * (total[row] - vx)
                grad_v = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * m.v[used]
                past_w[used] += grad_w**2
                past_v[used] += grad_v**2
                past_b += slope.sum() ** 2
                m.w[used] -= RATE * grad_w / np.sqrt(past_w[used])
                m.v[used] -= RATE / 4 * grad_v / np.sqrt(past_v[used])
                m.bias -= RATE * slope.sum() / math.sqrt(past_b)
        return m


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """Fitted on at most ``max_train`` labelled documents that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label")).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    n = usable.count()
    if n > 2 * max_train:  # so that few rows are sorted; twice the bound are left over on average
        usable = usable.where(F.col("h") < int(2 * max_train / n * (1 << 63)))
    sample = usable.orderBy("h", "doc_id").limit(max_train).select("doc_id", "label")
    rows = documents.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(sample), "doc_id")
    one = F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "n_chars"))  # of rows that share a doc_id the first by text
    texts = rows.groupBy("doc_id", "label").agg(one.alias("row")).select("doc_id", "label", "row.*")
    named = _vectors(texts, ["doc_id", "label"]).orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = named.toPandas()
    vectors = [(np.asarray(i, np.int64), np.asarray(x, np.float64)) for i, x in zip(rows["index"], rows["value"], strict=True)]
    return FactorisationMachine.fit(vectors, rows["label"].to_numpy(np.float64))


def _packed(documents: DataFrame) -> Column:
    """n_chars, a blank, and the text, so that one column holds what a score needs."""
    return F.concat(F.coalesce(F.col("n_chars").cast("string"), F.lit("-")).cast("binary"), F.lit(b" "), F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _unpacked(packed: bytes) -> tuple[bytes, int | None]:
    chars, _, text = packed.partition(b" ")
    return text, None if chars == b"-" else max(0, int(chars))


def _vectors(documents: DataFrame, keep: list[str]) -> DataFrame:
    def run(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        make = Featuriser()
        for t in texts:
            index, value = make.vector(*_unpacked(t))
            yield index.tolist(), value.tolist()

    return map_texts(documents.select(*keep, _packed(documents).alias("packed")), run, "index array<int>, value array<float>", keep, "packed")


def scored(documents: DataFrame, model: FactorisationMachine, keep: list[str]) -> DataFrame:
    """``keep`` columns and score of each document."""
    shared = documents.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def run(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        make, machine = Featuriser(), FactorisationMachine(*shared.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for t in texts:
            index, value = make.vector(*_unpacked(t))
            held.append((index, value.astype(np.float32).astype(np.float64)))
            size += len(index)
            if size >= AT_ONCE:
                yield from zip(machine.score(held))
                held, size = [], 0
        if held:
            yield from zip(machine.score(held))

    return map_texts(documents.select(*keep, _packed(documents).alias("packed")), run, "score double", keep, "packed")


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    found = scored(documents, model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
