"""Literal cases: shapes of series, valuation figures, ranges, imports, addresses, dates, pages, ticks."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
import time
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, web
from tidemark.operators import bars, fundamentals, identity, indicators, news, quality, valuation
from tidemark.streaming import ticks

BAR = "asset string, ts timestamp, open double, high double, low double, close double, volume bigint"
START = dt.datetime(2024, 1, 1)


def series(spark, closes: dict[str, list[float]]):
    rng, rows = random.Random(4), []
    for asset, values in closes.items():
        for i, c in enumerate(values):
            e = rng.uniform(-0.1, 0.1)
            o = c - e
            rows.append((asset, START + dt.timedelta(days=i), o, max(o, c) + abs(e) + 0.1, min(o, c) - abs(e) - 0.1, c, 1000 + i))
    return spark.createDataFrame(rows, BAR)


def column(df, name: str, asset: str) -> list:
    return [r[0] for r in df.where(F.col("asset") == asset).orderBy("ts").select(F.col(f"`{name}`")).collect()]


@pytest.fixture(scope="module")
def shapes(spark):
    sine = [100 + 10 * math.sin(4 * math.pi * i / 99) for i in range(100)]
    return series(spark, {"flat": [100.0] * 60, "up": [100 + 50 * i / 99 for i in range(100)], "sine": sine, "jump": [100.0] * 20 + [150.0] * 20, "hot": [100.0] * 20 + [100 + 7.5 * i for i in range(20)]}).cache()


def test_averages(shapes):
    out = indicators.indicators(shapes, ["sma_20", "ema_10", "sma_10"]).cache()
    sma = column(out, "SMA_20", "up")
    assert sma[:19] == [None] * 19 and None not in sma[19:]
    assert sma[30] == pytest.approx(sum(100 + 50 * i / 99 for i in range(11, 31)) / 20)
    assert set(column(out, "SMA_20", "flat")[19:]) == {100.0}
    ema, short = column(out, "EMA_10", "jump"), column(out, "SMA_10", "jump")
    assert ema[20] > short[20] and ema[21] > short[21] and ema[:9] == [None] * 9 and ema[9] == 100.0


def test_oscillators(shapes):
    out = indicators.indicators(shapes, ["rsi_14", "macd", "bbands_20", "stoch"]).cache()
    rsi = column(out, "RSI_14", "sine")
    assert rsi[0] is None and all(0 <= x <= 100 for x in rsi[1:])
    assert set(column(out, "RSI_14", "flat")) == {None} and max(x for x in column(out, "RSI_14", "hot") if x is not None) > 70
    line, hist, signal = (column(out, f"MACD{x}_12_26_9", "sine") for x in ("", "h", "s"))
    assert line[:25] == [None] * 25 and signal[:33] == [None] * 33
    assert all(h == pytest.approx(a - s) for a, h, s in zip(line, hist, signal) if h is not None)
    low, mid, up = (column(out, f"BB{x}_20_2.0_2.0", "sine") for x in "LMU")
    assert all(a <= b <= c for a, b, c in zip(low, mid, up) if a is not None)
    assert all(0 <= x <= 100 for x in column(out, "STOCHk_14_3_3", "sine") if x is not None)


def test_state_is_carried_across_batches(spark, shapes):
    whole = {(r.asset, r.ts): r.EMA_10 for r in indicators.indicators(shapes, ["ema_10"]).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = {(r.asset, r.ts): r.EMA_10 for r in indicators.indicators(shapes, ["ema_10"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole.keys() == cut.keys() and all(whole[k] == pytest.approx(cut[k]) for k in whole if whole[k] is not None)


def test_chunks_give_the_same(spark):
    rng, level, closes = random.Random(8), 100.0, []
    for _ in range(15_000):
        level *= 1 + rng.uniform(-0.02, 0.02)
        closes.append(level)
    rows = [("hot", START + dt.timedelta(minutes=30 * i), c, c + 0.5, c - 0.5, c, 100 + i % 7) for i, c in enumerate(closes)] + [("cold", START, 1.0, 1.0, 1.0, 1.0, 1)]
    bars = spark.createDataFrame(rows, BAR)
    specs = [n for n in indicators.CATALOG if n != "tema"] + ["tema_10"]
    whole, cut = indicators.indicators(bars, specs), indicators.indicators(bars, specs, chunk_rows=6000)
    assert whole.columns == cut.columns or set(whole.columns) == set(cut.columns)
    a, b = ({(r.asset, r.ts): r for r in df.collect()} for df in (whole, cut))
    assert a.keys() == b.keys() and len(b) == 15_001
    for k in a:
        for c in whole.columns[7:]:
            assert (a[k][c] is None) == (b[k][c] is None) and (a[k][c] is None or a[k][c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-6)), (k, c)
    with pytest.raises(ValueError):
        indicators.indicators(bars, ["rsi_14"], chunk_rows=100)


def test_names_and_screen(spark, shapes):
    assert indicators.parse("rsi_14") == ("rsi", {"length": 14}) and indicators.parse("bbands_20")[1] == {"length": 20, "std": 2.0} and indicators.parse("macd")[1] == {"fast": 12, "slow": 26, "signal": 9}
    with pytest.raises(ValueError):
        indicators.parse("nothing_3")
    assert {r.asset for r in indicators.screen(shapes, "rsi_14", "gt", 70).collect()} == {"up", "jump", "hot"}
    assert indicators.catalog_rows(spark).count() == 18


def test_normalise(spark):
    rows = [("a", START, 100.0, 90.0, 110.0, 105.0, -500, 0), ("a", START, 1.0, 1.0, 1.0, 1.0, 1, 1), ("b", START, None, 1.0, 1.0, 1.0, 1, 2), ("b", START, 1.0, 1.0, 1.0, 1.0, 1, 3), ("c", START, 1.0, float("nan"), 1.0, 1.0, 1, 4), ("d", START, 10.0, 12.0, 9.0, 11.0, None, 5)]
    got = {r.asset: r for r in bars.normalise(spark.createDataFrame(rows, BAR + ", ordinal int")).collect()}
    assert set(got) == {"a", "d"}
    assert (got["a"].high, got["a"].low, got["a"].volume, got["a"].adj_close, got["a"].source) == (110.0, 90.0, 0, 105.0, "unknown") and got["d"].volume == 0


def test_gap_ranges(spark):
    d = dt.date
    ranges = spark.createDataFrame([("new", None, None, 0), ("fresh", d(2024, 1, 1), d(2024, 6, 9), 9), ("old", d(2024, 1, 1), d(2024, 5, 1), 9)], "asset string, first date, last date, n long")
    got = {r.asset: (r.fetch_from, r.fetch_to, r.up_to_date) for r in bars.gap_ranges(ranges, "2024-06-10", start="2023-12-01").collect()}
    assert got == {"new": (d(2023, 12, 1), d(2024, 6, 10), False), "fresh": (d(2023, 12, 1), d(2023, 12, 31), False), "old": (d(2024, 5, 2), d(2024, 6, 10), False)}
    plain = {r.asset: r.up_to_date for r in bars.gap_ranges(ranges, "2024-06-10").collect()}
    assert plain == {"new": False, "fresh": True, "old": False}
    assert all(not r.up_to_date and r.fetch_to == d(2024, 6, 10) for r in bars.gap_ranges(ranges, "2024-06-10", force=True).collect())


COMPANY = dict(beta=1.2, market_cap=100e6, eps_trailing=None, pe_ratio=None, pe_forward=None, dividend_rate=None, dividend_yield=None, shares_outstanding=10_000_000, week_52_high=60.0, week_52_low=40.0, last_close=None, trend_0y=None, trend_1y=None)
STATEMENT = dict(revenue=None, ebit=10e6, operating_income=None, interest_expense=2e6, tax_provision=2.5e6, total_debt=40e6, total_equity=None, cash=None, operating_cashflow=None, capex=None, net_income=None, free_cashflow=None, dividends_paid=None, eps_diluted=None, eps_basic=None, shares_diluted=None, shares_basic=None)


def value(spark, company: dict | None = None, *statements: dict, steps=None):
    h = spark.createDataFrame([(1, *(COMPANY | (company or {})).values())], "asset_id int, " + ", ".join(f"{c} {'bigint' if c == 'shares_outstanding' else 'double'}" for c in COMPANY))
    rows = [(1, 2024 - i, *(STATEMENT | s).values()) for i, s in enumerate(statements or [{}])]
    s = spark.createDataFrame(rows, "asset_id int, period_end int, " + ", ".join(f"{c} double" for c in STATEMENT))
    facts = valuation.facts(h, s)
    return (valuation.valued(facts) if steps is None else valuation.applied(facts, steps)).first()


def test_cost_of_capital(spark):
    r = value(spark)
    assert (r.wacc, r.ke, r.kd, r.tax) == (0.0864, 0.106, 0.05, 0.25) and round(r.we, 4) == 0.7143
    debtless = dict(ebit=None, interest_expense=None, tax_provision=None, total_debt=None)
    r = value(spark, {"beta": 1.0}, debtless)
    assert (r.wacc, r.we, r.wd) == (0.095, 1.0, 0.0)
    assert value(spark, {"beta": 9.0}, debtless).wacc == 0.2 and value(spark, {"beta": 0.01}, debtless).wacc == 0.05
    assert value(spark, {}, {"tax_provision": None}).tax == 0 and value(spark, {}, {"interest_expense": None}).kd == 0 and value(spark, {}, {"ebit": 0.0, "operating_income": None}).tax == 0.25
    assert value(spark, {}, {"tax_provision": 15e6}).tax == 0.25 and value(spark, {}, {"tax_provision": -1e6}).tax == 0.25
    assert value(spark, {"market_cap": 0.0}, debtless | {"total_equity": 50e6}).equity == 50e6 and value(spark, {"market_cap": 0.0}, debtless).equity == 1e6


def test_models(spark):
    fixed = [("wacc", "0.10e0"), ("ke", "0.10e0"), *valuation.price_steps()]
    flow = [dict(free_cashflow=10e6, total_debt=20e6, cash=10e6), dict(free_cashflow=8e6 + 1e6)]
    assert value(spark, {}, *flow, steps=[*fixed, *valuation.fcf_steps(0.025, 0.05)]).fcf_value == pytest.approx(13.43, abs=0.05)
    capped = value(spark, {}, dict(free_cashflow=10e6, revenue=121e6), dict(revenue=100e6), steps=[*fixed, *valuation.fcf_steps()])
    assert capped.fcf_growth == pytest.approx(0.2)
    fallback = value(spark, {}, dict(operating_cashflow=15e6, capex=-3e6), steps=[*fixed, *valuation.fcf_steps()])
    assert fallback.fcf_start == 12e6 and fallback.fcf_growth == 0.04
    assert value(spark, {}, dict(free_cashflow=-10e6, total_debt=500e6), steps=[*fixed, *valuation.fcf_steps()]).fcf_value == 0
    eps = lambda pe: value(spark, {"eps_trailing": 2.0, "pe_ratio": pe}, steps=[*fixed, *valuation.eps_steps(0.025, 0.05)])
    assert eps(50.0).multiple == 30 and eps(5.0).multiple == 10 and eps(-3.0).multiple == 15 and eps(50.0).eps_value > eps(5.0).eps_value > 0
    assert value(spark, {"eps_trailing": -2.0}, {"eps_diluted": 0.0, "eps_basic": 3.0}).eps_start == 3 and value(spark, {"eps_trailing": -2.0}, {"eps_diluted": -1.0, "eps_basic": 3.0}).eps_start == 0.01
    assert value(spark, {"shares_outstanding": None}, {"shares_diluted": 0.0, "shares_basic": 7.0}).shares == 7 and value(spark, {"last_close": 0.0}).price == 50
    none = value(spark)
    assert none.ddm_value is None and none.ddm_status == "no dividend"
    assert value(spark, {"dividend_rate": 1.5}).ddm_value > 0
    r = value(spark, {"dividend_yield": 0.02, "pe_ratio": 15.0, "eps_trailing": 3.0})
    assert r.ddm_start == pytest.approx(0.9) and r.price == 45.0
    paid = value(spark, {}, dict(dividends_paid=-12.1e6), dict(dividends_paid=-10e6))
    assert paid.ddm_start == pytest.approx(1.21) and paid.ddm_growth == 0.15


def test_consensus_weights_and_grid(spark):
    df = spark.createDataFrame([(10.0, 20.0, None, 10.0)], "fcf_value double, eps_value double, ddm_value double, price double")
    r = valuation.applied(df, valuation.consensus_steps()).first()
    assert (r.consensus, r.upside) == (13.75, 37.5)
    assert valuation.grid(0.07, 0.11, 0.02) == [0.07, 0.09, 0.11]


def test_quality(spark):
    v = lambda *rows: spark.createDataFrame([("T", f"p{i}", f, float(x) if x is not None else None) for i, (f, x) in enumerate(rows)], "ticker string, provider string, field string, value double")
    status = lambda df: [r.status for r in df.orderBy("provider").collect()]
    assert status(quality.range_check(v(("pe_ratio", 0.01), ("pe_ratio", 5000), ("pe_ratio", 25), ("pe_ratio", 0.5), ("pe_ratio", 1000), ("pe_ratio", None)))) == ["out_of_range", "out_of_range", "ok", "ok", "ok", "null"]
    assert quality.consensus(quality.range_check(v(("pe_ratio", 20), ("pe_ratio", 22), ("pe_ratio", 21), ("pe_ratio", 99999)))).first().consensus == 21
    assert quality.consensus(quality.range_check(v(("pe_ratio", 20)))).count() == 0
    got = {r.provider: (r.status, r.accepted) for r in quality.validated(v(("pe_ratio", 24), ("pe_ratio", 25), ("pe_ratio", 0.8))).collect()}
    assert got["p2"] == ("outlier", None) and got["p0"] == ("ok", 24.0)
    closes = spark.createDataFrame([("a", 100.0)] * 10 + [("b", 100.0)] * 5, "asset string, close double")
    assert [tuple(r) for r in quality.dynamic_range(closes).collect()] == [("a", 94.0, 106.0)]


def test_import_and_primary(spark):
    rows = [(1, "A", "aaa", "US0378331005", "stock", "usd"), (2, "A", "AAA", "US0378331005", "STOCK", "USD"), (3, "A", "AAA", "US0378331005", "STOCK", "EUR"), (4, "B", "B", "bad", "STOCK", "USD"), (5, "", "C", "US0378331006", "ETF", "USD"), (6, "D", "D", "US0378331007", "FUND", "EU")]
    got = {r.ordinal: (r.errors, r.is_duplicate) for r in identity.checked_import(spark.createDataFrame(rows, "ordinal int, name string, ticker string, isin string, type string, currency string")).collect()}
    assert got == {1: ([], False), 2: ([], True), 3: ([], False), 4: (["isin"], False), 5: (["name"], False), 6: (["type", "currency"], False)}
    listings = spark.createDataFrame([("x", 1, "EUR", None), ("x", 2, "USD", None), ("y", 1, "EUR", False), ("y", 2, "EUR", None), ("y", 3, "USD", None), ("y", 4, "GBP", None), ("z", 1, "EUR", True), ("z", 2, "USD", None)], "isin string, ordinal int, currency string, was_primary boolean")
    flags = {(r.isin, r.ordinal): r.is_primary for r in identity.primary_flags(listings).collect()}
    assert {k for k, v in flags.items() if v} == {("x", 1), ("y", 3), ("z", 1)}


def test_identity(spark):
    rows = [("T", "etf", "USD", "import", True, "X", 1, 1), ("T", "stock", "EUR", "feed", False, "Y", 2, 2)]
    got = identity.by_identity(spark.createDataFrame(rows, "ticker string, type string, currency string, source string, is_primary boolean, exchange string, listing_id int, asset_id int")).first()
    assert got.listing_id == 2


def test_news(spark):
    slots = news.TitleSlots()
    for i, title in enumerate(["Apple beats estimates in Q2", "Apple beats estimates in Q2!", "Oil falls"]):
        slots.add(title, i, i)
    assert slots.rows == [1, 2]
    df = spark.createDataFrame([("http://A.com/x/?utm_source=t&b=1&a=&c=2#f",), ("http://a.com/x?b=1&c=2",), ("https://a.com/",), ("http://a.com/p;v=1?fbclid=3",)], "url string")
    assert [r[0] for r in df.select(web.canonical_url("url")).collect()] == ["http://a.com/x?b=1&c=2", "http://a.com/x?b=1&c=2", "https://a.com", "http://a.com/p"]


def one(spark, text: str | None, f) -> object:
    return spark.createDataFrame([(text,)], "t string").select(f("t")).first()[0]


def test_numbers(spark):
    assert one(spark, "1,5 %", numbers.safe_float) == 1.5 and one(spark, "N/A", numbers.safe_float) is None and one(spark, "12.9", numbers.safe_int) == 12
    assert one(spark, "$1,234.5M", numbers.magnitude) == 1234500000.0 and one(spark, "1 234,5 €", numbers.french_number) == 1234.5 and one(spark, "-", numbers.french_number) is None
    assert one(spark, "0,20 %", numbers.percent_ratio) == pytest.approx(0.002) and one(spark, "85,42 Mrd. EUR", numbers.currency_amount) == pytest.approx(85.42e9)
    assert [one(spark, x, lambda c: numbers.plain_number(F.col(c).cast("double"))) for x in ("12", "12.34", "120.50")] == ["12", "12.34", "120.5"]
    assert one(spark, "700", numbers.padded_ticker) == "00700" and one(spark, "AAPL", numbers.padded_ticker) == "AAPL"


def test_dates(spark):
    now = "2026-05-20 10:00:00"
    en = lambda x: one(spark, x, lambda c: dates.english_date(c, now))
    fr = lambda x: one(spark, x, lambda c: dates.french_date(c, now))
    assert en("3 hours ago") == dt.datetime(2026, 5, 20, 7) and en("Jan 15, 2025") == dt.datetime(2025, 1, 15) and en("May 16") == dt.datetime(2026, 5, 16) and en("nonsense") is None
    assert fr("16/05/2026") == dt.datetime(2026, 5, 16) and fr("il y a 2 h") == dt.datetime(2026, 5, 20, 8) and fr("hier") == dt.datetime(2026, 5, 19, 12)
    assert fr("15 mai 2026") == dt.datetime(2026, 5, 15) and fr("2026-05-01T10:00:00Z") == dt.datetime(2026, 5, 1, 10) and fr("31/02/2026") is None


def test_symbols(spark):
    got = [one(spark, t, web.stream_symbol) for t in ("AIR.PA", "BMW.DE", "AAPL")]
    assert [tuple(x) for x in got] == [("EURONEXT", "AIR"), ("XETRA", "BMW"), ("NASDAQ", "AAPL")]
    assert one(spark, "Société Générale", web.slug) == "societe-generale" and one(spark, "x/FR0000120271/y", web.isin_in) == "FR0000120271"


def test_pages():
    page = '<article><a href="/n/1"><b>Big</b> news today</a><time datetime="2026-05-01">x</time></article><a href="/s">abc</a><dl><dt>P/E</dt><dd>12.5</dd></dl><table><tr><th>Yield:</th><td>2 %</td></tr><tr><td>Beta</td><td>1.1</td></tr></table>'
    assert web.cards_of(page) == [{"url": "/n/1", "title": "Big news today", "time": "2026-05-01"}]
    assert web.labels_of(page) == [{"label": "P/E", "value": "12.5"}, {"label": "Yield", "value": "2 %"}, {"label": "Beta", "value": "1.1"}]
    assert web.cards_of(None) == [] and web.labels_of("<td>") == []


def test_form4():
    tx = "<nonDerivativeTransaction><transactionDate><value>2026-04-12</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>50000</value></transactionShares><transactionPricePerShare><value>172.45</value></transactionPricePerShare></transactionAmounts><postTransactionAmounts><sharesOwnedFollowingTransaction><value>3298456</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction>"
    got = web.form4_of(f"<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>X</rptOwnerName></reportingOwnerId></reportingOwner>{tx}</ownershipDocument>")
    assert (got[0]["type"], got[0]["total"], got[0]["owned_after"], got[0]["owner"]) == ("Sell", 8622500.0, 3298456.0, "X")
    assert web.form4_of("not XML") == []


def test_quote_frames(spark):
    message = '~m~99~m~{"m":"other"}~m~200~m~{"m":"timescale_update","p":["s",{"sds_1":{"s":[{"v":[1700000000,10,12,9,11,100]},{"v":[1]}]}}]}'
    got = web.quote_frames(spark.createDataFrame([(message,)], "message string")).collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(10.0, 12.0, 9.0, 11.0, 100)]


def test_statements_and_votes(spark):
    lines = spark.createDataFrame([(1, "Cash And Cash Equivalents", "2024", None), (1, "Cash Cash Equivalents And Short Term Investments", "2024", 7.0), (1, "Total Revenue", "2024", 5.0), (1, "else", "2024", 1.0)], "asset_id int, label string, period string, value double")
    r = fundamentals.statements(lines).first()
    assert (r.cash_and_equivalents, r.revenue, r.net_income) == (7.0, 5.0, None)
    votes = spark.createDataFrame([(8, 10, 5), (4, 4, 1), (0, 0, 0)], "strong int, buy int, hold int")
    assert [x[0] for x in votes.select(fundamentals.consensus_label({"strong": "Strong Buy", "buy": "Buy", "hold": "Hold"})).collect()] == ["Buy", "Strong Buy", None]


def test_ticks(spark):
    now = "2026-05-20 10:00:00"
    at = int(dt.datetime(2026, 5, 20, 10, tzinfo=dt.UTC).timestamp())
    rows = [(f'{{"ticker":"A","close":150.5,"timestamp":{at}}}',), (f'{{"ticker":"B","close":0,"timestamp":{at}}}',), (f'{{"Ticker":"C","Close":1,"Timestamp":{at + 120}}}',), (f'{{"ticker":"D","close":1,"timestamp":{at - 360}}}',), (f'{{"Ticker":"E","Close":2,"Timestamp":{at},"volume":-5}}',), ("no json",)]
    got = {r.asset: (r.price, r.volume) for r in ticks.valid(ticks.parsed(spark.createDataFrame(rows, "json string")), now).collect()}
    assert got == {"A": (150.5, None), "E": (2.0, None)}


def test_upserts_and_sources(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 3, None)], "k string, v int, w string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(bars.upsert(old, new, ["k"])) == [("a", 1, "x"), ("b", 9, "z"), ("c", 3, None)]
    assert rows(bars.upsert(old, new, ["k"], ["v"])) == [("a", 1, "x"), ("b", 9, "y"), ("c", 3, None)]
    assert rows(bars.insert_absent(old, new, ["k"])) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)]
    assert rows(bars.first_source(old, new, keys=["k"])) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)]


def test_members_of_an_index():
    from tidemark.sources.pages import rows_of

    page = '<table class="wikitable" id="constituents"><tr><th>Symbol</th><th>Security</th></tr><tr><td>MMM[1]</td><td><a>3M</a> Co.</td></tr><tr><td></td><td></td></tr></table><table class="wikitable"><tr><th>X</th></tr></table>'
    assert rows_of(page, "constituents") == rows_of(page) == [{"Symbol": "MMM", "Security": "3M Co."}]
    assert rows_of("<p>none</p>") == [] and rows_of(None) == []


def test_feeds_filings_and_mappings(spark):
    from tidemark.sources import pages

    make = lambda *rows, schema: spark.createDataFrame(list(rows), schema)
    feed = '{"subCards":[{"title":"A headline","url":"http://x/1","publishedDateTime":"2026-05-01T10:00:00Z","provider":"P"},{"headline":"no address"}]}'
    got = pages.feed_articles(make((feed,), schema="json string"), "msn").collect()
    assert [(r.title, r.url, r.source, r.published_at) for r in got] == [("A headline", "http://x/1", "P", dt.datetime(2026, 5, 1, 10))]
    subs = '{"filings":{"recent":{"form":["4","10-K","4"],"filingDate":["2026-04-14","2026-01-01","2026-04-12"],"accessionNumber":["a","b","c"]}}}'
    assert [(r.cik, r.accession) for r in pages.insider_filings(make((320193, subs), schema="cik int, json string"), 1).collect()] == [("0000320193", "a")]
    batch = '[{"data":[{"figi":"F1","ticker":"AAPL","exchCode":"US"}]},{"error":"No identifier found."}]'
    assert [tuple(r) for r in pages.identifier_mappings(make((["I1", "I2"], batch), schema="isins array<string>, json string")).collect()] == [("I1", "F1", "AAPL", "US")]
    fund = '{"ter":"0,20 %","fundSize":"85,42 Mrd. EUR","currency":"USD","holdings":[{"name":"A","percentage":"4,87 %"}]}'
    r = pages.fund_profile(make(("k", fund), schema="key string, json string")).first()
    assert r.ter == pytest.approx(0.002) and r["size"] == pytest.approx(85.42e9) and r.holdings[0].weight == pytest.approx(0.0487)


def test_records_are_written(spark, tmp_path):
    from tidemark.operators import search

    b = spark.createDataFrame([("a", START, 1.0, 2.0, 0.5, 1.5, 10)], BAR).withColumn("adj_close", F.lit(None).cast("double"))
    search.write_records(search.eod_records(b), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["date"] == "01-01-2024"
    search.write_bars(b, str(tmp_path / "bars"))
    assert spark.read.parquet(str(tmp_path / "bars")).where("month = '2024-01'").count() == 1
    with pytest.raises(ValueError):
        search.checked_ticker("a b")


def test_pieces_of_texts(spark):
    from tidemark.functions import names

    assert one(spark, "Société Générale ☃", names.without_accents) == "Societe Generale " and one(spark, "Škoda Łódź őŐ ﬁ", names.without_accents) == "Skoda odz oO "
    every = "".join(chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000)
    assert one(spark, every, names.without_accents) == "".join(unicodedata.normalize("NFD", c)[0] for c in every if unicodedata.normalize("NFD", c)[0].isascii())
    assert one(spark, "  Škoda – Ünïted & Co. ", web.slug) == "skoda-united-co"
    assert one(spark, "a1 b2 c3", lambda c: names.every_group(c, "([a-z])([0-9])", 2)) == ["a", "1", "b", "2", "c", "3"] and one(spark, "none", lambda c: names.every_group(c, "([0-9])", 1)) == []
    assert one(spark, "id=[x7] end", lambda c: names.between(c, "[", "]")) == "x7" and one(spark, "nothing", lambda c: names.between(c, "[", "]")) is None


def test_ticker_news(spark):
    at = lambda h: dt.datetime(2026, 5, 1, h)
    rows = [("T", 0, "Apple beats estimates in Q2", "http://x/1", "en", at(9)), ("T", 1, "Apple beats estimates in Q2", "http://x/1?utm_source=a", "en", at(10)), ("T", 2, "Apple beats the estimates in Q2", "http://x/2", None, at(11)), ("T", 3, "Gold rises", "http://x/3", "fr", at(12)), ("T", 4, "Oil falls sharply", "http://x/4", "en", None)]
    df = spark.createDataFrame(rows, "ticker string, ordinal int, title string, url string, language string, published_at timestamp")
    assert [r.ordinal for r in news.ticker_news(df, ["ticker"], "en", 5).orderBy(F.col("published_at").desc_nulls_last()).collect()] == [2, 4]


def test_ingest(spark):
    from tidemark.operators import assets

    day = lambda n: dt.datetime(2024, 1, n)
    stored = spark.createDataFrame([("a", day(1), 1.0, 1.0, 1.0, 1.0, 1), ("b", day(9), 1.0, 1.0, 1.0, 1.0, 1)], BAR)
    first = spark.createDataFrame([("a", day(1), 2.0, 2.0, 2.0, 2.0, 2, 0), ("a", day(5), 2.0, 2.0, 2.0, 2.0, 2, 1)], BAR + ", ordinal int")
    second = spark.createDataFrame([("a", day(6), 3.0, 3.0, 3.0, 3.0, 3, 0), ("c", day(6), 3.0, None, 3.0, 3.0, 3, 1), ("b", day(10), 3.0, 3.0, 3.0, 3.0, 3, 2)], BAR + ", ordinal int")
    bars_after, log = assets.ingest(stored, first, second, "2024-01-10")
    assert sorted((r.asset, r.ts.day, r.close) for r in bars_after.collect()) == [("a", 1, 1.0), ("a", 5, 2.0), ("b", 9, 1.0)]
    assert {r.asset: (r.status, r.n) for r in log.collect()} == {"a": ("success", 1), "b": ("up_to_date", 0), "c": ("failed", 0)}


def test_upsert_by_time_is_the_same_and_leaves_the_rest_alone(spark):
    rng = random.Random(4)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    old = spark.createDataFrame([(a, day(n), float(n), "old") for a in "abc" for n in range(60) if rng.random() < 0.7], "asset string, ts timestamp_ntz, v double, w string")
    new = spark.createDataFrame([(a, day(n), float(-n), "new") for a in "bcd" for n in range(20, 30)], "asset string, ts timestamp_ntz, v double, w string")
    for update in (None, ["v"]):
        assert rows(bars.upsert(old, new, ["asset", "ts"], update, time="ts")) == rows(bars.upsert(old, new, ["asset", "ts"], update))
    assert rows(bars.insert_absent(old, new, ["asset", "ts"], time="ts")) == rows(bars.insert_absent(old, new, ["asset", "ts"]))
    assert rows(bars.upsert(old, new.limit(0), ["asset", "ts"], time="ts")) == rows(old)


def test_asof_over_many_buckets(spark):
    rng = random.Random(5)
    at = lambda n: dt.datetime(2023, 1, 1) + dt.timedelta(hours=n)
    right = [(k, at(n), rng.choice([None, float(n)])) for k in "ab" for n in rng.sample(range(9000), 40)] + [("a", None, 7.0)]
    left = [(i, rng.choice(["a", "b", "c", None]), at(rng.randrange(-500, 9500))) for i in range(300)]
    left += [(1000 + i, k, t) for i, (k, t, _) in enumerate(right) if t]  # equal times
    got = {r.id: r.v for r in bars.asof(spark.createDataFrame(left, "id int, k string, ts timestamp_ntz"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v double"), "k", "ts", "v", "week").collect()}
    for i, k, t in left:
        known = [(x, v) for key, x, v in right if key == k and x is not None and v is not None and x <= t]
        assert got[i] == (max(known)[1] if known else None)


def literal_titles(rows: list[tuple]) -> list[int]:
    """The loop as it is described: (place, title, time), every title against all that stay."""
    plain = lambda t: re.sub(r"[^\w\s]", "", (t or "").lower())
    kept: list[tuple] = []
    for row in rows:
        for i, old in enumerate(kept):
            if SequenceMatcher(None, plain(row[1]), plain(old[1])).ratio() >= 0.85:
                if row[2] is not None and (old[2] is None or row[2] > old[2]):
                    kept[i] = row
                break
        else:
            kept.append(row)
    return sorted(r[0] for r in kept)


def test_titles_of_a_request_by_the_literal_loop(spark):
    rng = random.Random(6)
    words = "apple beats estimates oil falls sharply gold rises again on strong demand été 株価 records a b".split()
    made = []
    for i in range(500):
        title = None if i % 97 == 0 else "" if i % 89 == 0 else " ".join(rng.choices(words, k=rng.randint(3, 9)))
        if made and rng.random() < 0.5 and made[-1][1]:
            title = made[rng.randrange(len(made))][1]
            title = title and title.replace(rng.choice(words), rng.choice(words), 1) + rng.choice(["", "!", " x", "..."])
        made.append((i, title, rng.choice([None, dt.datetime(2024, 1, 1, rng.randrange(24))]), rng.choice(["A", "B", None]), f"http://n/{i}" if i % 50 else None))
    made += [(500 + i, "x" * 300 + str(i), None, "A", f"http://m/{i}") for i in range(6)]  # 200 characters and more
    df = spark.createDataFrame(made, "ordinal long, title string, published_at timestamp_ntz, ticker string, url string").withColumn("language", F.lit("en"))
    want = sorted(x for t in ("A", "B", None) for x in literal_titles([r[:3] for r in made if r[3] == t]))
    assert sorted(r.ordinal for r in news.title_dedup(df.repartition(5), ["ticker"]).collect()) == want
    got = news.ticker_news(df, ["ticker"], "en", 1000).collect()
    assert sorted(r.ordinal for r in got) == want and news.title_dedup(df.limit(0), ["ticker"]).collect() == []
    assert news.exact_dedup(df).count() == len(made)  # those without an address stay


def test_a_request_of_any_size_is_compared_whole(spark):
    df = spark.range(5000).select(F.col("id").alias("ordinal"), F.concat(F.sha2((F.col("id") % 2500).cast("string"), 256), F.lit(" "), (F.col("id") % 2500).cast("string")).alias("title"), F.timestamp_seconds("id").alias("published_at"), F.lit(1).alias("g"))
    began = time.perf_counter()
    assert sorted(r.ordinal for r in news.title_dedup(df, ["g"]).collect()) == list(range(2500, 5000))
    assert time.perf_counter() - began < 90


def test_reading_stops_after_three_failures_in_a_row(spark):
    from tidemark.sources import pages

    def places(oks: str, limit: int = 9, n: int = 1) -> list[int]:
        """o ok, x failure, - without a date."""
        rows = [("c", i, None if k == "-" else "2024-01-01", "a", k == "o", n) for i, k in enumerate(oks)]
        return sorted(r.place for r in pages.kept_fetches(spark.createDataFrame(rows, "company string, place int, filed string, accession string, ok boolean, n int"), limit).collect())

    assert places("oxxoxxo") == [0, 1, 2, 3, 4, 5, 6]
    assert places("oxxxo") == [0, 1, 2, 3] and places("xxxxo") == [0, 1, 2] and places("ox-x-xo") == [0, 1, 3, 5]
    assert places("o" * 20) == list(range(9)) and places("o" * 20, 3) == [0, 1, 2] and places("o" * 20, 3, 2) == [0, 1] and places("o" * 20, 50, 0) == list(range(15)) and places("ox" * 10, 4) == [0, 1, 2, 3, 4, 5, 6]


def test_requests_are_checked():
    from tidemark.operators.search import checked_request

    assert checked_request("BRK-B", "d", "2024-01-01", "2024-01-01") == ("BRK-B", False, "2024-01-01", "2024-01-01")
    for bad in (("TOOLONGTICKER",), ("A/B",), ("A", "x"), ("A", "a", "2024-02-01", "2024-01-01"), ("A", "a", "soon")):
        with pytest.raises(ValueError):
            checked_request(*bad)
