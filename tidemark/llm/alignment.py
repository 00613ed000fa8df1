r"""Alignment of two tokenizers over the same texts, and how often their tokens end together in the whole corpus.

A: byte-level BPE over a space and the text. B: pieces with byte fallback over the text, before which B puts a space itself. Both cover the same bytes, so
a text is cut into groups wherever a token of A and one of B end at the same byte; these two tokens are a link.

The texts of a block (an Arrow batch, or a part of it of at most ``BLOCK`` bytes or one text) are laid end to end. The ends of A's tokens and of B's
tokens are counted by one ``bincount`` each, cuts are where both occur, and prefix sums of the cuts, read at the documents' ends, give each
document's groups and links.

Of two linked tokens the shorter one's bytes end the longer one. So the pairs that can be linked at all are told by the vocabularies (``pairs``,
some hundred thousand for these two), and a table of their counts has that size whatever the corpus: it is summed by Spark and sent to all
tasks. The corpus is encoded once; links are written with the documents as numbers of pairs.

A null or empty text, and one whose joined tokens of either side differ from a space and the text (a text with U+2581, or one that isn't UTF-8), has no tokens: zeros and
''. Strings of special tokens inside texts are plain text. Very long texts are a block of their own. Repeated rows count each, rows without a doc_id too; of the documents'
columns only ``keep`` stay. An empty table gives an empty result. Vocabularies with empty tokens are refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

from .texts import table

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 500_000
#: How byte-level BPE splits a text before merging. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_BLANK = re.compile(r"\s{1000}")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Side(NamedTuple):
    pieces: list[bytes]  # bytes of each id
    lengths: np.ndarray
    encode: Callable[[list[str]], list[list[int]]]


def _byte_of() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def side_a(path: str) -> Side:
    """tiktoken over the vocabulary at ``path``, four times as fast as the library of its format; that one takes texts with very long white space, on which tiktoken's splitter
    overflows. A test holds the two equal over all code points."""
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))
    byte_of, special = _byte_of(), {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    pieces = [b"\0"] * (max(model["model"]["vocab"].values()) + 1)
    for token, i in ranks.items():
        pieces[i] = token

    def encode(texts: list[str]) -> list[list[int]]:
        return [fast.encode_ordinary(" " + t) if not _LONG_BLANK.search(t) else own_a(path)(" " + t) for t in texts]

    return Side(pieces, np.array([len(p) for p in pieces]), encode)


@lru_cache(maxsize=2)
def own_a(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def side_b(path: str) -> Side:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(own.get_piece_size()):
        piece = own.id_to_piece(i)
        byte = _BYTE.fullmatch(piece) if own.is_byte(i) else None
        pieces.append(bytes([int(byte[1], 16)]) if byte else piece.replace("\u2581", " ").encode())
    return Side(pieces, np.array([len(p) for p in pieces]), lambda texts: own.encode(texts, num_threads=1))


@lru_cache(maxsize=2)
def pairs(a_path: str, b_path: str) -> np.ndarray:
    """Sorted keys ``a * (size of B) + b`` of all pairs of which one side's bytes end the other's."""
    a, b = side_a(a_path), side_b(b_path)
    if min(a.lengths.min(), b.lengths.min()) == 0:
        raise ValueError("a vocabulary has an empty token")

    def ids(pieces: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, p in enumerate(pieces):
            out.setdefault(p, []).append(i)
        return out

    of_a, of_b, found = ids(a.pieces), ids(b.pieces), set()
    for mine, theirs, swap in ((of_a, of_b, False), (of_b, of_a, True)):
        for piece, own in mine.items():
            for k in range(len(piece)):
                for other in theirs.get(piece[k:], ()):
                    found.update((other, i) if swap else (i, other) for i in own)
    return np.array(sorted(x * len(b.pieces) + y for x, y in found), dtype=np.int64)


@lru_cache(maxsize=2)
def _decimals(a_path: str, b_path: str) -> list[bytes]:
    """Of each id its decimal and what follows it, inside a group and at its end: A's first, then B's."""
    a, b = len(side_a(a_path).pieces), len(side_b(b_path).pieces)
    return [x for i in range(a) for x in (b"%d," % i, b"%d|" % i)] + [x for i in range(b) for x in (b"%d," % i, b"%d;" % i)]


RESULT = "n_a long, n_b long, n_groups long, n_links long, groups string, links binary"


def align_block(texts: list[bytes | None], a_path: str, b_path: str) -> list[list]:
    """Columns of ``RESULT`` for the texts of a block: links are int32 numbers in ``pairs``."""
    a, b, keys = side_a(a_path), side_b(b_path), pairs(a_path, b_path)
    given = [i for i, t in enumerate(texts) if t]
    plain = [texts[i].decode("utf-8", "replace") for i in given]
    of_a, of_b = a.encode(plain), b.encode(plain)
    held = [k for k, i in enumerate(given) if b"".join(map(a.pieces.__getitem__, of_a[k])) == b" " + texts[i] == b"".join(map(b.pieces.__getitem__, of_b[k]))]
    out = [[0] * len(texts) for _ in range(4)] + [[""] * len(texts), [b""] * len(texts)]
    if not held:
        return out
    n_a, n_b = np.array([len(of_a[k]) for k in held]), np.array([len(of_b[k]) for k in held])
    ids_a = np.fromiter(chain.from_iterable(of_a[k] for k in held), np.int64, n_a.sum())
    ids_b = np.fromiter(chain.from_iterable(of_b[k] for k in held), np.int64, n_b.sum())
    end_a, end_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    at_a, at_b = np.bincount(end_a, minlength=end_a[-1] + 1), np.bincount(end_b, minlength=end_a[-1] + 1)
    cut = at_a * at_b  # links that end at each byte
    through, cuts = np.cumsum(cut), np.flatnonzero(cut)
    ends = end_a[np.cumsum(n_a) - 1]  # of the documents
    links_to, groups_to = through[ends], np.searchsorted(cuts, ends) + 1
    last_a, last_b = at_b[end_a] > 0, at_a[end_b] > 0
    number = np.searchsorted(keys, key := ids_a[last_a] * len(b.pieces) + ids_b[last_b])
    if not np.array_equal(keys[np.minimum(number, len(keys) - 1)], key):
        raise ValueError("linked tokens of which none ends the other")
    links = number.astype("<i4").tobytes()
    # A's and B's tokens in the order in which they are told: those of a group stand behind all tokens of the groups before
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a * 2 + last_a
    order[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * len(a.pieces) + ids_b * 2 + last_b
    told = list(map(_decimals(a_path, b_path).__getitem__, order.tolist()))
    tokens_to = np.cumsum(n_a + n_b)
    t = l = g = 0
    for j, k in enumerate(held):
        i = given[k]
        out[0][i], out[1][i], out[2][i], out[3][i] = int(n_a[j]), int(n_b[j]), int(groups_to[j] - g), int(links_to[j] - l)
        out[4][i] = b"".join(told[t : tokens_to[j]])[:-1].decode()
        out[5][i] = links[4 * l : 4 * links_to[j]]
        t, l, g = tokens_to[j], links_to[j], groups_to[j]
    return out


def _blocks(texts: list[bytes | None], size: int) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if texts:
        yield start, len(texts)


def aligned(documents: DataFrame, keep: list[str], a_path: str = A_PATH, b_path: str = B_PATH, block: int = BLOCK) -> DataFrame:
    """``keep`` columns of ``documents``, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) and links."""
    names = [c for c in keep if c not in ("n_a", "n_b", "n_groups", "n_links", "groups", "links")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for whole in batches:
            texts = whole.column("__text").to_pylist()
            for start, end in _blocks(texts, block):
                made = align_block(texts[start:end], a_path, b_path)
                own = whole.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), *(pa.array(c, t) for c, t in zip(made, types))], names=[*names, "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    given = documents.select(*(f"`{n}`" for n in names), F.col("text").cast("binary").alias("__text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in documents.select(*(f"`{n}`" for n in names)).dtypes)
    return given.mapInArrow(run, f"{schema}, {RESULT}" if schema else RESULT)


def pair_counts(rows: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """pair (a number in ``pairs``) and n of the links of all ``rows``: a sum in each task, then one over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(pairs(a_path, b_path)), np.int64)
        for b in batches:
            counts += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["pair", "n"])

    return rows.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(rows: DataFrame, counts: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """``rows`` with n_best (links whose count is the highest of their B id) and count_sum in place of links.

    ``counts`` has a row at most for each of ``pairs``, so it is collected and sent to the tasks whole.
    """
    keys, size = pairs(a_path, b_path), len(side_b(b_path).pieces)
    table_ = counts.toArrow()
    by_pair = np.zeros(len(keys), np.int64)
    by_pair[table_.column("pair").to_numpy()] = table_.column("n").to_numpy()
    highest = np.zeros(size, np.int64)
    np.maximum.at(highest, keys % size, by_pair)
    sent = rows.sparkSession.sparkContext.broadcast((by_pair, by_pair == highest[keys % size]))
    names = [c for c in rows.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for b in batches:
            links = b.column("links").to_pylist()
            number = np.frombuffer(b"".join(links), "<i4")
            ends = np.cumsum([len(x) // 4 for x in links], dtype=np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[number], dtype=np.int64)])[ends], prepend=0) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(s) for s in sums)], names=[*names, "n_best", "count_sum"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*(f"`{n}`" for n in names)).dtypes)
    return rows.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def spread(documents: DataFrame) -> DataFrame:
    """``documents``, a scan of files, dealt over all cores where it has fewer partitions than there are cores: encoding costs more than moving the texts."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return documents.repartition(cores) if documents.rdd.getNumPartitions() < cores else documents


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    told = materialise(rows.withColumn("groups_sha256", digest).drop("groups"))
    return with_counts(told, pair_counts(told)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
