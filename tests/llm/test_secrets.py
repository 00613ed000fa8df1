"""Secrets without a keyword, of formats that the automata learned from labelled ones."""

from __future__ import annotations

import os
import random
import string
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tidemark.llm.secrets import Background, Scorer, find_secrets, fit, op9_secret_automata, scan, symbols  # noqa: E402

SYLLABLES = ["er", "the", "an", "tion", "or", "in", "at", "wh", "on", "le", "st", "re", "and", "ing", "ou", "ea", "es", "ti", "ha", "ed"]
ORDINARY = ["release-2024.01", "https://example.org/articles/index.html", "555-7713-2210", "McDonaldson", "INTRODUCTION", "user.name", "state-of-the-art", "2024-01-05T10:00", "src/main/java/Thing.java", "20240105", "photograph_of_landing"]


def secrets_of(rng: random.Random) -> dict[str, str]:
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    mixed = string.ascii_letters + string.digits
    return {
        "prefixed": "sk-" + pick("0123456789abcdef", 24),
        "short": pick(mixed, 12),
        "letters": pick(string.ascii_letters, 20),
        "dotted": ".".join((pick(mixed, 16), pick(mixed, 20), pick(mixed, 16))),
    }


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory) -> tuple[str, dict]:
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 6))) for _ in range(60))
    rows, want = [], {}
    for i in range(1200):
        text = f"Ünd {prose()} {rng.choice(ORDINARY)} {prose()}"
        if i < 200:
            name, value = rng.choice(sorted(secrets_of(rng).items()))
            text += f' {rng.choice(["token", "api_key", "PASSWORD"])} = "{value}" {prose()}'
        elif i < 300:
            name, value = sorted(secrets_of(rng).items())[i % 4]
            want[i] = (name, len(text) + 1, len(text) + 1 + len(value), value)
            text += f" {value} {prose()}"
        rows.append((i, text))
    d = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{d}/documents.parquet")
    return d, want


def test_learnt_spans_of_planted_formats(spark, planted):
    d, want = planted
    rows = {r.doc_id: r for r in find_secrets(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id", "text"]).collect()}
    found = [(i, s.start, s.end) for i, r in rows.items() for s in r.learnt]
    right = [x for x in found if x[0] in want and want[x[0]][1:3] == x[1:]]
    assert len(right) >= 0.9 * len(want), {want[i][0]: want[i][3] for i in want.keys() - {x[0] for x in right}}
    assert len(right) >= 0.9 * len(found), [rows[i].text[a:b] for i, a, b in found if (i, a, b) not in right]
    for r in rows.values():
        assert all(r.text[s.start : s.end] == s.value and s.label == "assign" for s in r.learnt)
        assert r.n_candidates >= len(r.spans) + len(r.learnt)
        assert all(s.label == "assign" and s.score > 0 for s in r.spans)  # base spans are scored too


def test_query_tells_learnt_spans_and_keeps_base_ones(spark, planted):
    d, want = planted
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op9_secret_automata(spark, d).collect()
    for r in rows:
        counts, digest, joined = brute.secret_base(texts[r.doc_id])
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == (counts, digest)
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("learnt:")] == (joined.split(",") if joined else [])
        assert sum(s.startswith("learnt:") for s in spans) == r.n_learnt
    assert sum(r.n_learnt for r in rows) >= 0.9 * len(want)


def test_pieces_beside_base_spans_and_long_values():
    rng = random.Random(4)
    key = lambda n=24: "".join(rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    scorer = Scorer(fit({"key": [key() for _ in range(200)] + [key(5000)]}), Background())
    hexes = "0123456789abcdef" * 3
    text = f"é {key()}/{hexes}/{key()} end"
    base, learnt, n = scan(text.encode(), scorer)
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in base] == [("hex", hexes)] and n == 3
    assert [s["value"].strip("/") for s in learnt] == [text[2:26], text[-28:-4]]
    base, learnt, _ = scan(("see " + key(9000) + ".").encode(), scorer)  # whole values, whatever their length
    assert [s["end"] - s["start"] for s in learnt] in ([9000], [9001])


def test_score_is_the_ratio_of_two_probabilities():
    import math

    model, _ = fit({"k": ["a1" * i for i in range(1, 40)]})["k"]
    background = Background({0 * 12 + 2: 5, 2 * 12 + 1: 7, 1 * 12 + 2: 3, 1 * 12 + 0: 2})
    s = symbols("a1a1")
    at, before, total = 0, 0, 0.0
    for c in [*s, 0]:
        total += model.log[at][c] - math.log2(2 ** background.log[before][c])
        at, before = model.to[at][c], c
        if at < 0:
            break
    assert model.score(s, background) == pytest.approx(total / 5)
