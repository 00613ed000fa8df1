"""Plain single-machine versions of the operators' contracts, written without the operators' code."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def alnum(text: str | None) -> list[str]:
    return ALNUM.findall((text or "").translate(LOWER))


def decontamination(doc: str | None, items: list[tuple[object, str | None]]) -> tuple:
    words = alnum(doc)
    hit, found = set(), set()
    for item_id, text in items:
        other = alnum(text)
        if not other:
            continue
        n = min(13, len(other))
        windows = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)}
        for s in range(len(words) - n + 1):
            if tuple(words[s : s + n]) in windows:
                hit.update(range(s, s + n))
                if item_id is not None:
                    found.add(str(item_id))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


def quality_metrics(text: str | None) -> tuple:
    text = text or ""
    words = BLANK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] >= 2 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def license_base(text: str | None) -> tuple:
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    words = alnum(text)
    found = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def simhash(text: str | None) -> int:
    words = BLANK.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _least(rows: list[tuple], linked) -> list[int | None]:
    """The smallest id that each row reaches by links."""
    n = len(rows)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(n)]


def components(rows: list[tuple[int | None, int]]) -> list[int | None]:
    """By links of 4 bits at most."""
    return _least(rows, lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= 4)


def similar_components(rows: list[tuple[int | None, str | None]]) -> list[int | None]:
    """By links of a similarity of 4/5 or more between sets of five-word shingles; texts without words are copies."""
    words = [BLANK.findall((t or "").translate(LOWER)) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w) for w in words]
    near = lambda x, y: 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y))
    return _least(rows, lambda i, j: near(sets[i], sets[j]))


def secret_base(text: str | None) -> tuple:
    text = text or ""
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
    return tuple(sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")), sha(joined), joined


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def size(text: str | None) -> int:
    return len(BLANK.findall(text or ""))


def targets(sizes: dict) -> dict:
    """Target of each source, by water filling step by step."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, free, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out
