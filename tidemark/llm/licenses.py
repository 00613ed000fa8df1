r"""License scans: one Aho-Corasick automaton over words, and licence expressions by the shunting-yard algorithm.

A text's lower-cased words are joined by blanks, and an automaton of all phrases runs over them once; a match counts where it starts and
ends with words. Base phrases are counted and placed; notice phrases add labels of their own. Where the automaton meets the tag
``spdx license identifier``, the expression behind that tag is read at its place in the text: identifiers joined by AND, OR and WITH, and
parentheses. Each tag is read once, so the time grows with the text whatever the tags are. WITH binds closest, then AND, then OR; the expression goes to postfix order and is evaluated twice, to the set of
labels and to whether its terms can be met by permissive licences alone (OR: either side, AND: both, WITH: as the licence).

A malformed expression counts up to its fault, and WITH between groups tells the labels of both. Score is the strength of the evidence: 1 for a tag, else 1 less the product of the
phrases' doubts, 0 where nothing is found. Null and empty texts have no words and no labels. Rows are told one by one.
An empty table gives an empty result. Other columns are left out unless kept, and those that the result names too are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import alnum_words, map_texts, table

#: Phrase (words): label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrase (words): label, doubt that it grants that licence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.1),
    "gnu affero general public license": ("agpl", 0.1),
    "mozilla public license": ("mpl", 0.1),
    "eclipse public license": ("epl", 0.1),
    "bsd 2 clause": ("bsd-2-clause", 0.1),
    "bsd 3 clause": ("bsd-3-clause", 0.1),
    "redistribution and use in source and binary forms": ("bsd", 0.1),
    "permission is hereby granted free of charge": ("mit", 0.1),
    "creative commons attribution": ("cc-by", 0.2),
    "cc by sa": ("cc-by-sa", 0.1),
    "cc by nc": ("cc-by-nc", 0.1),
    "cc0 1 0": ("cc0", 0.1),
    "released into the public domain": ("public-domain", 0.2),
    "the unlicense": ("unlicense", 0.3),
    "all rights reserved": ("proprietary", 0.3),
}
TAG = "spdx license identifier"
BASE_DOUBT = 0.15
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPELLED = b"spdx-license-identifier"
_BEHIND = re.compile(rb"[ \t]*:[ \t]*([A-Za-z0-9.+\-() \t]+)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}
#: Starts of identifiers whose terms are permissive.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "cc-by-1", "cc-by-2", "cc-by-3", "cc-by-4", "0bsd", "bsl-1", "postgresql", "python")
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<string>, permissive boolean, score double"


def postfix(expression: str) -> list[str]:
    """The terms and operators of an expression in postfix order, up to its first fault."""
    out: list[str] = []
    waiting: list[str] = []
    term_next = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word == "(" and term_next:
            waiting.append(word)
        elif word == ")" and not term_next and "(" in waiting:
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif word in _BINDS and not term_next:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            term_next = True
        elif word not in "()" and word not in _BINDS and term_next:
            out.append(word)
            term_next = False
        else:
            break
    rest = [x for x in reversed(waiting) if x != "("]
    return out + (rest[1:] if term_next and rest else rest)  # an operator without its second term falls away


def _both(a: set[str], b: set[str]) -> set[str]:
    """The union, made of the larger one."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    a |= b
    return a


def evaluate(terms: list[str]) -> tuple[set[str], bool] | None:
    """Labels, and whether permissive licences alone can meet the terms."""
    stack: list[tuple[set[str], bool]] = []
    for t in terms:
        if t in _BINDS:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if t == "with":
                stack.append(({f"{next(iter(a))} with {next(iter(b))}"} if len(a) == len(b) == 1 else _both(a, b), x))
            else:
                stack.append((_both(a, b), (x or y) if t == "or" else (x and y)))
        else:
            stack.append(({t}, t.startswith(PERMISSIVE)))
    return stack[-1] if stack else None


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        a.add_word(phrase, [(phrase, label, BASE_DOUBT, True)])
    for phrase, (label, doubt) in NOTICES.items():
        a.add_word(phrase, [(phrase, label, doubt, False)])
    a.add_word(TAG, [(TAG, None, 0.0, False)])
    a.make_automaton()
    return a


class _Places:
    """Where a text's words end, in bytes."""

    def __init__(self, text: bytes):
        self.text, self.ends, self.at, self.word = text, None, 0, 0

    def expression(self, joined: str, start: int) -> str | None:
        """What stands behind the tag whose words begin at ``start`` of the joined words; tags come in order."""
        if self.ends is None:
            self.ends = [m.end() for m in _WORD.finditer(self.text)]
        self.word += joined.count(" ", self.at, start)
        self.at = start
        end = self.ends[self.word + 2]
        if self.text[max(0, end - len(_SPELLED)) : end].lower() != _SPELLED:
            return None
        m = _BEHIND.match(self.text, end)
        return m and m[1].decode()


def scan(text: bytes | None, phrases: ahocorasick.Automaton) -> tuple:
    words = alnum_words(text or b"")
    places = _Places(text or b"")
    joined = b" ".join(words).decode()
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    expressions: list[str] = []
    doubt, permissive, at, word = 1.0, None, 0, 0
    for end, found in phrases.iter(joined):
        if end + 1 < len(joined) and joined[end + 1] != " ":
            continue
        for phrase, label, d, is_base in found:
            start = end + 1 - len(phrase)
            if start and joined[start - 1] != " ":
                continue
            if label is None:
                if (read := places.expression(joined, start)) and (result := evaluate(postfix(read))):
                    expressions.append(read.strip())
                    labels |= result[0]
                    permissive = result[1] if permissive is None else permissive and result[1]
                    doubt = 0.0
                continue
            labels.add(label)
            doubt *= d
            if is_base:
                base.add(label)
                # Matches come by their ends, so a start may lie before the last one; both directions are counted from there.
                word += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
                at = start
                starts.append(word)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), expressions, permissive, 1.0 - doubt if labels else 0.0


def license_scan(documents: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns of ``documents`` with RESULT."""

    def run(texts: Iterator[bytes | None]) -> Iterator[tuple]:
        phrases = automaton()
        for t in texts:
            yield scan(t, phrases)

    return map_texts(documents, run, RESULT, keep, text)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("expressions", "; ").alias("expressions"), "permissive")
