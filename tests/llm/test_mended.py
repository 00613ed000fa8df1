"""Cases that earlier versions got wrong: the mix by rows, and recognition of personal data, spelled out and in linear time."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, pseudonyms, secrets


def targets_of(sizes: dict) -> dict:
    """The contract's targets, by giving excess away until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            out[s] = 2 * sizes[s] if over else level * weight[s]
        left -= sum(2 * sizes[s] for s in over)
        free -= over if over else free
    return out


def test_rows_without_an_id_or_with_the_same_one_are_drawn_each(spark):
    rng = random.Random(1)
    rows = [(None if i % 2 else i % 20, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", None]), i // 4) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part int").withColumn("copies", F.lit(9))
    found = mixing.mixed_documents(docs).collect()
    sizes: dict = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(t.split())
    taken: dict = defaultdict(int)
    for r in found:
        assert r.taken == r.copies * len(r.text.split()) and r.copies in (1, 2)
        taken[r.source] += r.taken
    for s, target in targets_of(sizes).items():
        assert taken[s] == pytest.approx(target, abs=max(60, 0.01 * target))
    again = mixing.mixed_documents(docs.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


# What is recognised, spelled out: kind and value inside of a text.
SPANS = [
    ("write to bob.c@mail.example.org, please", [("email", "bob.c@mail.example.org")]),
    ("..bob@x.org and a+b%c@x-y.co.uk.", [("email", "bob@x.org"), ("email", "a+b%c@x-y.co.uk")]),
    ("(415) 555-2671.bob@x.org", [("phone", "(415) 555-2671"), ("email", "bob@x.org")]),
    ("x" * 90 + "@long.org", [("email", "x" * 90 + "@long.org")]),
    ("no@domain no@ @x.org a@b.c1", []),
    ("born 1980-02-29 or 3/4/1990 or 31.12.1999, not 1981-02-29", [("date", "1980-02-29"), ("date", "3/4/1990"), ("date", "31.12.1999")]),
    ("ssn 123-45-6789, not 000-45-6789 nor 666-12-1234", [("ssn", "123-45-6789")]),
    ("at 10.1.2.3 and 255.255.255.255, not 1.2.3.4.5 nor 256.1.1.1", [("ip", "10.1.2.3"), ("ip", "255.255.255.255")]),
    ("call +1 415 555 2671 or 415-555-2671", [("phone", "+1 415 555 2671"), ("phone", "415-555-2671")]),
    ("GB82 WEST 1234 5698 7654 32 and DE89370400440532013000", [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]),
    ("card 4111 1111 1111 1111 123 or 4111-1111-1111-1112", [("card", "4111 1111 1111 1111")]),
]


def test_what_is_recognised(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPANS)], "doc_id int, text string")
    for r in pseudonyms.pseudonymise(rows).collect():
        text, spans = SPANS[r.doc_id]
        counts = {k: sum(kind == k for kind, _ in spans) for k in [*pseudonyms.KINDS, "card"]}
        assert r.n_pii == counts, text
        rest = text
        for _, value in spans:
            assert value not in r.text, text
            before, rest = rest.split(value, 1)
            assert before in r.text, text
        assert r.text.endswith(rest), text


@pytest.mark.parametrize("unit", ["1.", "a-1_", "a@b.", "....a"])
def test_a_million_characters_take_seconds(spark, unit):
    text = unit * (1_000_000 // len(unit))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.perf_counter()
    assert docs.transform(pseudonyms.pseudonymise).select(F.length("text")).first()[0] > 0
    assert time.perf_counter() - began < 60


def test_what_the_driver_learns_from_is_bounded(spark):
    """Pasted dumps of any length neither reach the driver nor crowd out the rest."""
    rows = [("hex", f"{i:032x}") for i in range(300)] * 2 + [("hex", f"{i:x}" * 40_000) for i in range(200)] + [("access", "AKIA" + "A" * n) for n in range(30_000, 30_012)]
    values = spark.createDataFrame(rows, "kind string, value string")
    got = secrets.labelled_values(values)
    assert all(sum(map(len, v)) <= secrets.CHARACTERS and len(v) <= secrets.SAMPLE for v in got.values())
    assert sum(len(v) == 32 for v in got["hex"]) > 150 and all(v in {r[1] for r in rows} for k in got for v in got[k]) and len(got["access"]) == 3
    assert secrets.labelled_values(values.limit(0)) == {}
