r"""Quality rules with risk-controlled thresholds.

Each rule compares a figure of a text with a cutoff. The labelled documents that pass the base rules are a holdout on which cutoffs are chosen, for each
stratum (the language) by itself. One half of them orders configurations (a cutoff for each rule, or off): from all off, the
change of one rule that rejects the most of the bad documents less ``PRICE`` times the share of good ones comes next, until none gains. The other
half tests the configurations in that order: "this one, all rules together, rejects more than ``alpha`` of the good documents" is
refuted by an exact binomial tail at the level ``delta`` over the number of strata (Bonferroni); the first one that isn't refuted ends the sequence
(fixed-sequence testing, so its length costs nothing), and the last one that was refuted holds. With a probability of 1 - ``delta`` no stratum loses
more than ``alpha`` of the good documents that pass the base rules; what those reject isn't bounded. Equal texts are one
trial and so are several labels of a document (the largest counts); near copies aren't told, so the bound is as good as their labels are independent. A stratum with
too few labels (fewer than 86 good ones in the testing half, with four strata) has all rules off.

Cutoffs are constants and don't depend on the data. Counts are over all labelled documents, in partial aggregations; what a task gets of a stratum is
a row for each combination of cutoffs exceeded, 8 ** 5 at most for each label and half.
Null texts have no words. Rows with null labels aren't used. A null language is a stratum of its own. Very long texts are measured whole, repeated rows each by itself.
Without labels only the base rules hold. An empty table gives an empty result. Other columns are kept by
``quality_filter``; those of ``documents`` that METRICS names too are replaced in ``text_metrics``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

from .texts import blank_words, map_texts, table, word_chars

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, text_key long"
SYMBOLS = b"#*$%&|<>"
ALPHA, DELTA, PRICE, SEED = 0.05, 0.05, 20.0, 42
#: Name, figure, and cutoffs from lenient to strict; a document is rejected above the cutoff.
RULES = [
    ("symbols", "n_symbols / greatest(n_words, 1)", [2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05]),
    ("repeated lines", "n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    ("repeated words", "n_repeat_words / greatest(n_words, 1)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    ("long words", "word_chars / greatest(n_words, 1)", [25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0]),
    ("short words", "n_words / greatest(word_chars, 1)", [0.6, 0.5, 0.4, 0.33, 0.28, 0.25, 0.22]),
]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == n:
        return 0
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) >= 1 << 21:  # else three numbers fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for j in range(3):
        inside[j : j + n - 2] |= again
    return int(inside.sum())


def metrics_of(text: bytes | None) -> tuple[int, int, int, int, int, int, int]:
    text = text or b""
    words = blank_words(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), word_chars(text), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), int.from_bytes(xxhash.xxh64_digest(text, SEED), "big", signed=True)


def text_metrics(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``documents`` with METRICS of each whole text."""
    return map_texts(documents, lambda texts: map(metrics_of, texts), METRICS, keep)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial distribution, summed from k down until the terms vanish."""
    if k >= n:
        return 1.0
    if k >= n * p:  # above the mean: no evidence that the rate is below p
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top, total, term, i = log(k), 0.0, 1.0, k
    while term > 1e-18 * max(total, 1.0) and i >= 0:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p if i else 0.0
        i -= 1
    return min(1.0, math.exp(top) * total)


STEPS = len(RULES[0][2])  # of each rule; step 0 is off, step k the k-th cutoff


def rejected(exceeded: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """Which rows of ``exceeded`` (how many cutoffs of each rule a figure exceeds) the configuration ``steps`` rejects."""
    at = np.array(steps)
    return ((at > 0) & (exceeded + at > STEPS)).any(axis=1)


def path(exceeded: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple[int, ...]]:
    """Configurations from lenient to strict, chosen on how many good and bad documents have each row of ``exceeded``."""
    now, out = (0,) * exceeded.shape[1], []
    value = bad / max(1, bad.sum()) - PRICE * good / max(1, good.sum())
    while True:
        here = value[rejected(exceeded, now)].sum()
        options = [(*now[:r], k, *now[r + 1 :]) for r in range(len(now)) for k in range(now[r] + 1, STEPS + 1)]
        gains = [value[rejected(exceeded, x)].sum() - here for x in options]
        if not gains or max(gains) <= 1e-12:
            return out
        now = options[int(np.argmax(gains))]
        out.append(now)


def choose(configurations: list[tuple[int, ...]], exceeded: np.ndarray, good: np.ndarray, alpha: float, level: float) -> tuple[int, ...] | None:
    """The last of ``configurations`` before the first whose risk isn't refuted on the good documents; None: all rules off."""
    best = None
    for steps in configurations:
        if not good.sum() or tail(int(good[rejected(exceeded, steps)].sum()), int(good.sum()), alpha) > level:
            break
        best = steps
    return best


def fit_cutoffs(metrics: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum: stratum, and c0, c1, ... the cutoffs of RULES (null: off)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    exceeded = [sum((F.expr(figure) > c).cast("int") for c in cutoffs).alias(f"e{r}") for r, (_, figure, cutoffs) in enumerate(RULES)]
    names = [f"e{r}" for r in range(len(RULES))]
    labelled = metrics.join(known, "doc_id").where(~base_failed()).select(F.col(stratum).alias("stratum"), "text_key", "quality", *exceeded)
    trials = labelled.groupBy("stratum", "text_key", *names).agg(F.max("quality").alias("quality"))  # equal texts have equal figures
    half = F.pmod(F.xxhash64(F.lit(SEED), "text_key"), F.lit(2)).cast("int").alias("half")
    cells = materialise(trials.groupBy("stratum", half, *names).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")))
    level = delta / max(1, cells.select("stratum").distinct().count())
    kind = dict(metrics.dtypes)[stratum]

    def chosen(f: pd.DataFrame) -> pd.DataFrame:
        halves = [f[f["half"] == i].sort_values(names) for i in (0, 1)]
        (x, good, bad), (y, tested, _) = ((h[names].to_numpy(), h["good"].to_numpy(), h["bad"].to_numpy()) for h in halves)
        steps = choose(path(x, good, bad), y, tested, alpha, level) or (0,) * len(RULES)
        out = {"stratum": [f["stratum"].iloc[0]]} | {f"c{r}": [cutoffs[k - 1] if k else None] for r, ((_, _, cutoffs), k) in enumerate(zip(RULES, steps, strict=True))}
        return pd.DataFrame(out).astype(object).where(lambda d: d.notna(), None)

    return materialise(cells.groupBy("stratum").applyInPandas(chosen, f"stratum {kind}, " + ", ".join(f"c{r} double" for r in range(len(RULES)))))


def judged(metrics: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``metrics`` with base_failed, kept and rejected_by (names of rules)."""
    few = cutoffs.count() <= 10_000
    named = cutoffs.select(F.col("stratum").alias("_stratum"), *(F.col(f"c{r}").alias(f"_c{r}") for r in range(len(RULES))))
    joined = metrics.join(F.broadcast(named) if few else named, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    reasons = F.filter(F.array(*(F.when(F.expr(figure) > F.col(f"_c{r}"), F.lit(name)) for r, (name, figure, _) in enumerate(RULES))), lambda x: x.isNotNull())
    out = joined.withColumns({"base_failed": base_failed(), "rejected_by": reasons}).drop("_stratum", *(f"_c{r}" for r in range(len(RULES))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_filter(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that no rule rejects, columns as they are. The texts are read twice and never shuffled."""
    cutoffs = fit_cutoffs(text_metrics(documents, ["doc_id", stratum]), labels, stratum)
    own = {c: f"in_{c}" for c in documents.columns if c not in ("text", stratum)}
    kept = judged(text_metrics(documents.withColumnsRenamed(own)), cutoffs, stratum).where("kept")
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in documents.columns))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = materialise(text_metrics(table(spark, sf_dir, "documents"), ["doc_id", "lang"]))
    cutoffs = fit_cutoffs(metrics, table(spark, sf_dir, "labels"))
    return judged(metrics, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
