"""The sieve lets every row through that has a key, and most others not."""

from __future__ import annotations

from tidemark.llm.sieve import sieved


def test_no_key_is_lost(spark):
    rows = spark.range(20_000).selectExpr("if(id % 100 = 0, null, id) as k", "concat('t', id) as __of_text", "id as n")
    keys = spark.range(0, 20_000, 7).selectExpr("cast(id as int) as x")
    maybe, never = sieved(rows, "k", keys)
    assert maybe.columns == never.columns == rows.columns
    a, b = ({r.n for r in x.collect()} for x in (maybe, never))
    assert not a & b and a | b == set(range(20_000))
    assert {n for n in range(0, 20_000, 7) if n % 100} <= a and len(a) < 3500
    assert sieved(rows, "k", keys.limit(0))[0].isEmpty() and sieved(rows.limit(0), "k", keys)[1].isEmpty()
