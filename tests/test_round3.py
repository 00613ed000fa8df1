"""Tests for the findings of the third round."""

from __future__ import annotations

import random
import time
import weakref
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from tidemark.llm import similar
from tidemark.operators import identity, news, search
from tidemark.plans import catalog, feeds
from tidemark.sources import adapters, connectors, pages
from tidemark.streaming import stateful


def test_a_request_meets_one_listing_of_a_key(spark):
    k = F.col("id")
    listings = spark.range(20000).select(
        (k % 400).alias("asset_id"), k.alias("listing_id"), F.lit("I").alias("isin"), F.lit("T").alias("ticker"), F.lit("X").alias("exchange"), F.lit("stock").alias("type"), F.lit("USD").alias("currency"), F.lit("import").alias("source"),
        (k == 777).alias("is_primary"),
    )
    requests = spark.range(20000).select(k.alias("request_id"), F.when(k % 3 == 0, "I").alias("isin"), F.when(k % 5 != 0, "T").alias("ticker"), F.when(k % 2 == 0, "X").otherwise("Y").alias("exchange"))
    began = time.perf_counter()
    got = {r.request_id: (r.asset_id, r.way) for r in identity.resolved(requests, listings).collect()}
    assert time.perf_counter() - began < 60  # 4e8 pairs would take longer
    assert len(got) == 20000 and all(got[i] == ((377, 1) if i % 3 == 0 else (None, None) if i % 5 == 0 else (377, 2) if i % 2 == 0 else (377, 3)) for i in range(20000))


def test_equal_hits_go_by_their_columns_whatever_their_order(spark):
    rows = [(1, "q", "Q", "ETF", True, 1.0, "US", f"I{i:03}") for i in range(50)]
    kind = "request_id int, query string, symbol string, kind string, own boolean, score double, country string, isin string"
    for order in (search.quote_order, search.symbol_order):
        got = {search.best(spark.createDataFrame(made, kind).coalesce(1), order()).first().isin for made in (rows, rows[::-1], rows[25:] + rows[:25])}
        assert got == {"I000"}


def test_pages_are_read_on_all_cores(spark, sf_dir):
    found = catalog.queries()
    for name in ("insider_tables", "connector_fields", "connector_filled", "html_label_values", "html_cards", "index_members", "news_cards", "page_headings"):
        plan = found[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning(8)" in plan, name  # each table is a file of one partition
    assert adapters.spread(spark.range(0, 10, 1, 20)).rdd.getNumPartitions() == 20  # what has partitions enough stays


def test_rows_of_one_row_group_are_dealt_though_its_file_has_many_cuts(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.range(20000).coalesce(1).write.parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "4096")
    try:
        scan = spark.read.parquet(path)
        sizes = [n for n in scan.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n]
        assert scan.rdd.getNumPartitions() > 8 and sizes == [20000]  # many cuts, of which one has all rows
        dealt = [n for n in adapters.spread(scan).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(dealt) == 20000 and len(dealt) >= 8 and max(dealt) < 5000


def test_a_company_document_is_read_once_and_made_where_its_asset_is(spark, sf_dir):
    plan = catalog.queries()["company_sections"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "get_json_object" not in plan and plan.count("SortMergeJoin") >= 10  # one task made all documents of a small table, and read each once for each path
    texts = ['{"a": {"b": "x \\"y\\"", "n": 1.25E7, "0": {"c": null}}, "b": -3, "l": {"10": 1, "1": "z"}}', '{"a": null}', "{}", None]
    paths = ["a.b", "a.n", "a.0.c", "b", "l.1", "none.x"]
    found, get = feeds._read_once(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "asset_id int, document string"), paths)
    told = lambda p: F.get_json_object("document", "$" + "".join(f"['{x}']" for x in p.split(".")))
    for row in found.select(F.array(*map(get, paths)).alias("once"), F.array(*map(told, paths)).alias("each")).collect():
        assert row.once == row.each


def test_titles_of_one_language_are_told_apart_in_time():
    rng = random.Random(3)
    parts = "th nd in re ou er an ea sh st on es ha at hei tion ble ing ".split()
    made = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))) for _ in range(1200)]
    made += [made[i] if i % 3 else made[i].replace("th", "t", 4) for i in range(600)]  # copies and near copies
    slots, began = news.TitleSlots(), time.perf_counter()
    for i, title in enumerate(made):
        slots.add(title, None, i)
    assert time.perf_counter() - began < 12 and slots.rows[:1200] == list(range(1200))
    for i in range(1200, len(slots.rows)):  # those that took a place are like none before
        assert all(SequenceMatcher(None, made[slots.rows[i]], made[j]).ratio() < news.SIMILAR for j in (slots.rows[i] - 1200, 0, 1))


def test_a_title_that_came_before_meets_places_that_changed_since():
    a, b, c = "apple beats estimates in the quarter", "apple beats estimates in the quarters", "apple beats the estimates in quarters"
    rng, ratio = random.Random(5), lambda x, y: SequenceMatcher(None, x, y, autojunk=True).ratio()
    for _ in range(300):
        slots, want, kept = news.TitleSlots(), [], []
        for i in range(25):
            title, at = rng.choice([a, b, c, a[5:], b[:-7], c + a[:9], ""]), rng.choice([None, rng.randrange(30)])
            slots.add(title, at, i)
            place = next((k for k, (t, _, _) in enumerate(kept) if ratio(title, t) >= news.SIMILAR), None)
            if place is None:
                kept.append((title, at, i))
            elif at is not None and (kept[place][1] is None or at > kept[place][1]):
                kept[place] = (title, at, i)
        want = [r for _, _, r in kept]
        assert slots.rows == want


class _List:
    def __init__(self) -> None:
        self.rows: list = []

    def get(self):
        return iter(self.rows)

    def put(self, rows) -> None:
        self.rows = list(rows)

    def appendList(self, rows) -> None:
        self.rows += rows


class _Handle:
    def __init__(self) -> None:
        self.lists: dict[str, _List] = {}

    def getListState(self, name: str, schema: str) -> _List:
        return self.lists.setdefault(name, _List())

    def registerTimer(self, at: int) -> None:
        self.at = at


def test_a_batch_is_read_frame_by_frame():
    for processor, active in ((stateful._LastValues(60_000_000), None), (stateful._Subscribed(), None)):
        handle, alive, most = _Handle(), [], []
        processor.init(handle)

        def frames():
            for i in range(9):
                f = pd.DataFrame({"event_id": [i], "ts": pd.to_datetime([1_700_000_000 + 30 * (9 - i)], unit="s"), "price": [float(i)], "active": pd.Series([active], dtype=object)})
                alive.append(weakref.ref(f))
                most.append(sum(r() is not None for r in alive))
                yield f
                del f

        assert all(len(x) == 0 for x in processor.handleInputRows(("a",), frames(), None))
        assert max(most) <= 2 and len(handle.lists.get("runs", handle.lists.get("waiting")).rows) in (1, 9)  # one run, or nine ticks


def test_links_that_fingerprints_propose_count_without_a_shared_band(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {5: words, 3: [*words[:-1], "x"], 9: [*words[:-2], "y", "z"], 4: words[::-1]}  # near copies, and another text
    documents = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    rows = similar.materialise(similar.map_texts(documents, similar._signatures, "key long, n int, fp long, bands array<long>", ["doc_id"]))
    bandless = rows.withColumn("bands", F.array().cast("array<long>"))
    got = {r.doc_id: r.component_id for r in similar.components_of(documents, bandless).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 4: 4}
    assert {r.doc_id: r.component_id for r in similar.similar_components(documents).collect()} == got


def test_page_figures_are_told_row_by_row(spark, sf_dir):
    eps = "<table><tr><td>EPS</td><td>{}</td></tr></table>"
    rows = [
        (1, "barrons", eps.format(1.5), 1.5, None, None), (1, "barrons", eps.format(2.5), 2.5, None, None), (None, "barrons", eps.format(3.5), 3.5, None, None), (2, None, eps.format(4.5), None, None, None), (3, "barrons", None, None, None, None),
        (4, "zonebourse", "<table><tr><th>PER</th><td>-</td></tr><tr><th>P/E, PER</th><td>1 2,5 €</td></tr><tr><th>BPA</th><td>7</td></tr></table>", 7.0, 12.5, None), (5, "googlefinance", "<dl><dt>Net income</dt><dd>$1.5M</dd></dl>", None, None, 1.5e6), (6, "nobody", eps.format(1), None, None, None),
    ]
    made = spark.createDataFrame([r[:3] for r in rows], "key int, provider string, html string")
    got = [(r.key, r.provider, r.eps, r.pe_ratio, r.net_income) for r in pages.page_metrics(made).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], r[1], *r[3:]) for r in rows), key=repr)  # pages of one key told each other's figures, and those without a key none
    plan = catalog.queries()["page_metrics"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_a_field_is_a_column_and_tables_tell_all_their_rows(spark, sf_dir):
    rows = [
        ("zonebourse", "<table><tr><td>PER<td>1,5<tr><td>PER<td>n<td>2,5<tr><td>PER<td>-</table><h1>a</h1><h1>b</h1>"), ("barrons", "<div><p>EPS<p>none</div><div><p>EPS<p>3.5</div><div>EPS: 4</div>"), ("msn", None), ("barrons", "<p>"),
        ("ZoneBourse", "<p class=esg-rank> A </p><table><tr><th>EPS<td>7</table>"),
    ]
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key int, provider string, html string").repartition(1)
    got = connectors.provider_fields(made)
    assert sorted((r.key, r.status, r.name, r.pe_ratio, r.eps, r.esg_score) for r in got.collect()) == [(0, "ok", "a", 2.5, None, None), (1, "ok", None, None, 3.5, None), (2, "error", None, None, None, None), (3, "no_data", None, None, None, None), (4, "ok", None, None, 7.0, "A")]
    assert "found" not in got._jdf.queryExecution().executedPlan().toString()  # each field was filtered out of a list of all
