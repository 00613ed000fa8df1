"""The data sources of stored frames: rows, pushed filters, counted bars, and a stream that is taken up again."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter

import pytest

from tidemark.sources import frames


def framed(*payloads: str) -> str:
    return "".join(f"~m~{len(p)}~m~{p}" for p in payloads)


def message(*bars: list) -> str:
    return json.dumps({"m": "timescale_update", "p": ["s", {"sds_1": {"s": [{"v": b} for b in bars]}}]})


def at(*day: int) -> int:
    return int(dt.datetime(*day, tzinfo=dt.timezone.utc).timestamp())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    root = tmp_path_factory.mktemp("frames")
    frames.register(spark)
    for asset in ("A", "B%23x"):
        for month in (1, 2, 3):
            own = root / f"asset={asset}" / f"period=2024-{month:02d}"
            own.mkdir(parents=True)
            bars = [[at(2024, month, d), d, d + 1, d - 0.5, d + 0.25, 10 * d] for d in (1, 9, 20)]
            (own / "one.txt").write_text(framed("~h~1", "é not json", message(*bars[:2])) + "\n" + framed(message([at(2024, month, 9), 0, 0, 0, 0, 0])) + "~m~999~m~cut short\n")
            (own / "two.txt").write_text(framed(message(bars[2], [at(2024, month, 21), 1, 2], [at(2024, month, 22), 1, None, 1, 1, 1], ["x", 1, 1, 1, 1, 1], [at(2024, month, 25), 1, 1, 1, 1]), '{"m":"other"}', '{"m":"timescale_update","p":[]}', "[1]"))
            (own / "_hidden").write_text("no")
    (root / "_SUCCESS").write_text("")
    return str(root)


def test_whole_bars_are_told(spark, folder):
    rows = spark.read.format("quote_frames").option("path", folder).load().collect()
    assert len(rows) == 2 * 3 * 4 and {r.asset for r in rows} == {"A", "B#x"}
    one = {r.ts.day: r for r in rows if r.asset == "A" and r.ts.month == 2}
    assert one[1].close == 1.25 and one[9].close == 0 and one[20].volume == 200 and one[25].volume == 0  # the last bar of a time stands


def test_filters_choose_partitions(spark, folder):
    load = lambda **options: spark.read.format("quote_frames").options(path=folder, **options).load()
    every = load()
    assert every.rdd.getNumPartitions() == 2
    for condition, parts, n in (("asset = 'A'", 1, 12), ("asset in ('B#x', 'C') and ts >= timestamp_ntz'2024-02-09'", 1, 7), ("ts > timestamp_ntz'2024-01-20' and ts < timestamp_ntz'2024-02-09'", 2, 4), ("asset = 'C'", 1, 0), ("asset = 'A' and asset = 'B#x'", 0, 0), ("ts <= timestamp_ntz'2024-01-09' and close > 1", 2, 2), ("asset = 'A' or close > 20", 2, 15)):
        told = load(prune="true").where(condition)
        assert (told.rdd.getNumPartitions(), told.count()) == (parts, n), condition
        assert every.where(condition).count() == n and every.count() == 24  # without it a DataFrame serves any number of queries
    assert load(assets="A,C").rdd.getNumPartitions() == 1
    plan = load(prune="true").where("asset = 'A' and close > 1")._jdf.queryExecution().executedPlan().toString()
    assert "= A)" not in plan.split("Filter")[1].split("\n")[0]


def test_only_the_newest_bars_are_asked_for(spark, folder):
    def days(start: str, end: str, resolution: str = "1D") -> list:
        df = spark.read.format("quote_frames").options(path=folder, start=start, end=end, resolution=resolution).load()
        return sorted((r.ts.month, r.ts.day) for r in df.where("asset = 'A'").collect())

    every = [(m, d) for m in (1, 2, 3) for d in (1, 9, 20, 25)]
    assert days("2024-01-01", "2024-03-30") == every
    assert days("2024-01-10", "2024-01-20") == [(1, 20)]  # the newest 10 of 12 bars are asked for, and the range cuts nine
    assert days("2024-02-01", "2024-03-30", "1W") == every[4:] and days("2024-01-01", "2024-02-22", "1M") == [(2, 20)]
    assert frames.bars_asked(400, "1D") == 400 and frames.bars_asked(0, "1M") == 5 and frames.bars_asked(70, "1W") == 15


def test_each_tick_comes_once_over_restarts(spark, tmp_path):
    frames.register(spark)
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def take() -> Counter:
        stream = spark.readStream.format("tick_frames").option("path", str(source)).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return Counter(r.json for r in spark.read.schema("json string").parquet(out).collect())

    assert take() == Counter()
    (source / "000.txt").write_text(framed("a", "b") + "\n" + framed("half")[:-1])  # a line that isn't ended waits
    assert take() == Counter("ab")
    (source / "000.txt").write_text(framed("a", "b") + "\n" + framed("half") + "\n" + framed("ü" * 50_000) + "\n")
    (source / "001.txt").write_text(framed("c", "d") + "\n")
    assert take() == Counter(["a", "b", "half", "ü" * 50_000, "c", "d"])
    (source / "001.txt").write_text(framed("c", "d") + "\n" + framed("e") + "\n")
    (source / "002.txt").write_text(framed("f") + "\n")
    assert take() == take() == Counter(["a", "b", "half", "ü" * 50_000, "c", "d", "e", "f"])


def test_offsets_can_be_replayed(tmp_path):
    (tmp_path / "a").write_text(framed("1") + "\n" + framed("2") + "\n")
    (tmp_path / "b").write_text(framed("3") + "\n")
    reader = frames.TickFrames({"path": str(tmp_path)}).streamReader(None)
    start = {"file": "a", "bytes": 7}
    end = reader.latestOffset()
    (tmp_path / "b").write_text(framed("3") + "\n" + framed("4") + "\n")
    for _ in range(2):
        assert [row[0] for p in reader.partitions(start, end) for row in reader.read(p)] == ["2", "3"]
    assert [row[0] for p in reader.partitions(end, reader.latestOffset()) for row in reader.read(p)] == ["4"]


def test_partitions_are_assets_and_months(folder):
    def files(**options) -> list[tuple[str, list[str]]]:
        reader = frames.QuoteFrames({"path": folder, **options}).reader(None)
        return [(p.asset, [f.split("period=")[1] for f in p.files]) for p in reader.partitions()]

    assert sorted(files()) == [(a, [f"2024-{m:02d}/{n}.txt" for m in (3, 2, 1) for n in ("one", "two")]) for a in ("A", "B#x")]
    assert files(assets="A", start="2024-02-03", end="2024-02-05") == [("A", ["2024-03/one.txt", "2024-03/two.txt", "2024-02/one.txt", "2024-02/two.txt"])]
    reader = frames.QuoteFrames({"path": folder, "prune": "true"}).reader(None)
    left = list(reader.pushFilters([frames.EqualTo(("asset",), "A"), frames.LessThan(("ts",), dt.datetime(2024, 2, 1)), frames.GreaterThan(("close",), 1.0)]))
    assert [type(f) for f in left] == [frames.GreaterThan]
    assert [[f.split("period=")[1][:7] for f in p.files] for p in reader.partitions()] == [["2024-02", "2024-02", "2024-01", "2024-01"]]
    assert {row[1].month for p in reader.partitions() for row in reader.read(p)} == {1}
