"""Stateful streams over files in any order, stored tables that are changed in place, and alerts in batch and stream."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, quality
from tidemark.session import scratch_path
from tidemark.sources import stored
from tidemark.streaming import stateful, ticks

@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store for each partition is opened in every batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


DAY0 = dt.datetime(2024, 1, 1)
TICK = "event_id long, asset string, ts timestamp, price double"


def streamed(spark, path: str, batches: list[list], schema: str):
    """A stream that takes one file of ``batches`` at a time, in their order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    kept = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(kept).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(path)


# --- alerts


def checks_of(days: list[tuple[int, str]]) -> list[tuple]:
    """A check an hour apart for each letter: o ok, r out of range, x outlier, n null, t timeout."""
    kind = {"o": "ok", "r": "out_of_range", "x": "outlier", "n": "null", "t": "timeout"}
    return [("p", DAY0 + dt.timedelta(days=d, hours=h), kind[c]) for d, letters in days for h, c in enumerate(letters)]


def events_of(days: list[tuple[int, str]], open_: set[str] = frozenset()) -> list[tuple]:
    """The rules read literally, day by day."""
    now, out = set(open_), []
    for d, letters in sorted(days):
        bad, rate = sum(c in "rx" for c in letters), round(letters.count("o") / len(letters), 4)
        for kind, stands, severe in (("canary_failed", bad > 0, bad >= 3), ("high_outlier_rate", rate < 0.85, rate < 0.7)):
            if stands and kind not in now:
                now.add(kind)
                out.append((kind, "opened", d, "critical" if severe else "warning"))
        if set(letters) == {"o"} and "canary_failed" in now:
            now.remove("canary_failed")
            out.append(("canary_failed", "resolved", d, None))
    return sorted(out, key=str)


DAYS = [(0, "ooooo"), (1, "oottt"), (2, "oooor"), (3, "orxxo"), (4, "nnnnn"), (5, "ooooo"), (6, "ooooo"), (7, "xoooo"), (8, "ooooooooot"), (9, "o"), (10, "rrr"), (11, "o"), (12, "o"), (13, "o")]


def test_timeouts_and_nulls_are_no_failures(spark):
    health = quality.daily_health(spark.createDataFrame(checks_of([(0, "oottt"), (1, "onoox")]), "provider string, ts timestamp, status string").withColumn("date", F.to_date("ts")))
    assert {(r.date.day, r.type, r.severity) for r in quality.alerts(health).collect()} == {(1, "high_outlier_rate", "critical"), (2, "canary_failed", "warning"), (2, "high_outlier_rate", "critical")}
    assert {r.date.day: (r.total, r.ok, r.outlier, r.out_of_range, r.missing, r.timeout) for r in health.collect()} == {1: (5, 2, 0, 0, 3, 3), 2: (5, 3, 1, 0, 1, 0)}


def test_alert_history_is_the_literal_one(spark):
    health = quality.daily_health(spark.createDataFrame(checks_of(DAYS), "provider string, ts timestamp, status string").withColumn("date", F.to_date("ts")))
    found = []
    for r in quality.alert_history(health).collect():
        found.append((r.type, "opened", r.opened.day - 1, r.severity))
        if r.resolved:
            found.append((r.type, "resolved", r.resolved.day - 1, None))
    assert sorted(found, key=str) == events_of(DAYS)


@pytest.mark.parametrize("open_", [frozenset(), frozenset({"canary_failed"}), frozenset({"high_outlier_rate", "canary_failed"})])
def test_streamed_alerts_are_those_of_the_history_in_any_order(spark, tmp_path, open_):
    rows, rng = checks_of(DAYS), random.Random(len(open_))
    near = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.uniform(0, 40)))  # up to 40 hours late
    stream = streamed(spark, str(tmp_path / "c"), [near[i : i + 20] for i in range(0, len(near), 20)], "provider string, ts timestamp, status string")
    known = spark.createDataFrame([("p", k, dt.date(2023, 12, 1)) for k in open_] or [("q", "canary_failed", dt.date(2023, 12, 1))], "provider string, type string, opened date")
    found = [(r.type, r.event, (r.date - DAY0.date()).days, r.severity) for r in ticks.available_now(stateful.alert_events(stream, known, "2 days"), "append").collect()]
    over = [d for d in DAYS if d[0] + 1 <= 13 - 2]
    assert sorted(found, key=str) == events_of(over, open_)


# --- values that expire, and subscriptions


def ticks_of(seed: int, n: int = 400) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), DAY0 + dt.timedelta(seconds=rng.choice([20 * i, 20 * i, 20 * i + 7])), float(i)) for i in range(n)]


def shuffled(rows: list[tuple], seed: int, late: int) -> list[list[tuple]]:
    rng = random.Random(seed)
    near = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.uniform(0, late)))
    cuts = sorted(rng.sample(range(1, len(near)), 3))
    return [near[a:b] for a, b in zip([0, *cuts], [*cuts, len(near)])]


def expiries(rows: list[tuple], ttl: int, watermark: dt.datetime) -> Counter:
    out: Counter = Counter()
    for asset in {r[1] for r in rows}:
        own = sorted((ts, i, p) for i, a, ts, p in rows if a == asset)
        for now, after in zip(own, [*own[1:], None]):
            end = now[0] + dt.timedelta(seconds=ttl)
            if (after is None or after[0] >= end) and end <= watermark:
                out[(asset, now[0], now[2], end)] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_values_expire_by_event_time_in_any_order(spark, tmp_path, seed):
    rows = ticks_of(seed)
    stream = streamed(spark, str(tmp_path / "t"), [*shuffled(rows, seed, 200), [(None, "a", None, None), (9, None, DAY0, 1.0)]], TICK)
    found = Counter(map(tuple, ticks.available_now(stateful.expired_values(stream, 40, "5 minutes"), "append").collect()))
    assert found == expiries(rows, 40, max(r[2] for r in rows) - dt.timedelta(minutes=5)) and len(found) > 20


def test_expired_keys_leave_the_state(spark, tmp_path):
    rows = [(1, "gone", DAY0, 1.0), (2, "here", DAY0, 1.0), (3, "here", DAY0 + dt.timedelta(hours=1), 2.0)]
    stream = stateful.expired_values(streamed(spark, str(tmp_path / "t"), [rows], TICK), 60)
    query = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "runs").load(str(tmp_path / "state"))
    assert {r[0] for r in state.select("key.asset").collect()} == {"here"}


def told(rows: list[tuple], changes: list[tuple], watermark: dt.datetime) -> Counter:
    out: Counter = Counter()
    for i, a, ts, p in rows:
        known = [(t, not on, on) for b, t, on in changes if b == a and t <= ts]
        if known and max(known)[2] and ts < watermark:
            out[(i, a, ts, p)] += 1
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_subscriptions_change_while_ticks_come(spark, tmp_path, seed):
    rows, rng = ticks_of(seed), random.Random(seed)
    changes = [(rng.choice("ab"), DAY0 + dt.timedelta(seconds=20 * rng.randrange(410)), rng.random() < 0.5) for _ in range(60)] + [("a", DAY0 + dt.timedelta(seconds=8200), True)]
    near = [[(a, t, on) for _, _, t, (a, on) in batch] for batch in shuffled([(0, "", t, (a, on)) for a, t, on in changes], seed, 200)]
    t = streamed(spark, str(tmp_path / "t"), shuffled(rows, seed, 200), TICK)
    c = streamed(spark, str(tmp_path / "c"), near, "asset string, ts timestamp, active boolean")
    found = Counter(map(tuple, ticks.available_now(stateful.subscribed_ticks(t, c, "10 minutes"), "append").collect()))
    mark = min(max(r[2] for r in rows), max(x[1] for x in changes)) - dt.timedelta(minutes=10)
    assert found == told(rows, changes, mark) and len(found) > 20


# --- stored tables

BARS = "asset string, ts timestamp_ntz, close double, volume long"


def table_of(spark, path: str) -> Counter:
    return Counter(tuple(r) for r in stored.stored(spark, path).select("asset", "ts", "close", "volume").collect())


def files_of(path) -> dict[str, set[str]]:
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in path.iterdir() if "=" in p.name}


def test_stored_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    at = lambda m, d: dt.datetime(2024, m, d)
    path = tmp_path / "bars"
    old = [(a, at(m, d), float(m), d) for a in "abc" for m in (1, 2, 3, 4) for d in (1, 9)]
    first = spark.createDataFrame(old, BARS)
    assert stored.upsert_stored(str(path), first, ["asset", "ts"]) == ["2024-01", "2024-02", "2024-03", "2024-04"]
    before = files_of(path)
    new = spark.createDataFrame([("a", at(2, 1), -1.0, -1), ("z", at(3, 5), -2.0, -2), ("z", at(5, 5), -3.0, -3)], BARS)
    assert stored.upsert_stored(str(path), new, ["asset", "ts"]) == ["2024-02", "2024-03", "2024-05"]
    after = files_of(path)
    assert all(after[f"month=2024-{m}"] == before[f"month=2024-{m}"] for m in ("01", "04")) and after["month=2024-02"] != before["month=2024-02"]
    want = bars.upsert(first, new, ["asset", "ts"])
    assert table_of(spark, str(path)) == Counter(tuple(r) for r in want.collect())
    stored.upsert_stored(str(path), new, ["asset", "ts"])  # once more changes nothing
    part = spark.createDataFrame([("a", at(1, 1), 99.0, 99), ("n", at(1, 2), 7.0, 7)], BARS)
    stored.upsert_stored(str(path), part, ["asset", "ts"], update=["volume"])
    assert table_of(spark, str(path)) == Counter(tuple(r) for r in bars.upsert(want, part, ["asset", "ts"], ["volume"]).collect())
    assert stored.upsert_stored(str(path), new.limit(0), ["asset", "ts"]) == []
    with pytest.raises(ValueError):
        stored.upsert_stored(str(path), spark.createDataFrame([("a", None, 1.0, 1)], BARS), ["asset", "ts"])


def test_a_crash_loses_nothing(spark, tmp_path):
    path = tmp_path / "bars"
    rows = lambda v: spark.createDataFrame([(a, dt.datetime(2024, m, 1), v, 1) for a in "ab" for m in (1, 2)], BARS)
    stored.upsert_stored(str(path), rows(1.0), ["asset", "ts"])
    stored.upsert_stored(str(path), rows(2.0), ["asset", "ts"], finish=False)  # dies after the mark
    assert {k[2] for k in table_of(spark, str(path))} == {1.0}
    batch = next((path / stored.STAGING).iterdir())
    (path / "month=2024-01").rename(tmp_path / "gone")  # ... or in the middle of a move
    stored.recover(spark, str(path))
    assert {k[2] for k in table_of(spark, str(path))} == {2.0} and sum(table_of(spark, str(path)).values()) == 4 and not batch.exists()
    stored.upsert_stored(str(path), rows(3.0), ["asset", "ts"], finish=False)
    next(f for f in (next((path / stored.STAGING).iterdir())).iterdir() if f.name == stored.COMPLETE).unlink()  # dies before the mark
    stored.recover(spark, str(path))
    assert {k[2] for k in table_of(spark, str(path))} == {2.0} and not list((path / stored.STAGING).iterdir())


def test_old_partitions_go_by_their_names(spark, tmp_path):
    path = str(tmp_path / "bars")
    days = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=n), 1.0, n) for n in range(10)], BARS)
    stored.upsert_stored(path, days, ["asset", "ts"], unit=stored.DAY, name="day")
    kept = files_of(tmp_path / "bars")
    assert stored.drop_before(spark, path, "2024-01-04") == ["day=2024-01-01", "day=2024-01-02", "day=2024-01-03"]
    assert files_of(tmp_path / "bars") == {k: v for k, v in kept.items() if k >= "day=2024-01-04"}
    plan = stored.stored(spark, path).where("day >= '2024-01-09'")
    assert len(plan.inputFiles()) == 2 or "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.volume for r in stored.stored(spark, path).collect()) == list(range(3, 10))


def test_a_stream_that_runs_again_upserts_the_same(spark, tmp_path):
    rows = [(i, "a", DAY0 + dt.timedelta(hours=5 * i), float(i)) for i in range(60)]
    path = scratch_path(spark)
    for k in (0, 1):
        stream = streamed(spark, str(tmp_path / f"t{k}"), [rows[:30], rows[20:]], TICK).withColumn("volume", F.lit(1))
        stored.upsert_stream(ticks.minute_bars(stream, "1 day"), path, ["asset", "ts"], f"{path}-state{k}", keep_days=5).awaitTermination()
        assert sorted(r.ts.day for r in stored.stored(spark, path).collect()) == [8, 9, 10, 11, 12, 13]


def test_faulty_messages(spark):
    import datetime as dt

    from tidemark.streaming import ticks

    cases = {
        '{"ticker":"a","close":1}': (dt.datetime(2024, 1, 3), 1.0, None), '{"ticker":"a","close":1,"volume":0}': (dt.datetime(2024, 1, 3), 1.0, 0), '{"ticker":"a","close":1,"timestamp":"x"}': None, '{"ticker":"a","close":1,"volume":"x"}': None, '{"ticker":"a"}': None,
        '{"ticker":"a","close":null,"Close":2,"time":"2024-01-01"}': (dt.datetime(2024, 1, 1), 2.0, None), "[1]": None, "": None, '{"ticker":"a","close":1e400}': None, '{"ticker":"a","close":false,"Close":3,"volume":"5"}': (dt.datetime(2024, 1, 3), 3.0, 5),
    }
    made = spark.createDataFrame([(k,) for k in cases] + [(None,)], "json string")
    got = sorted((r.ts, r.price, r.volume or 0) for r in ticks.valid(ticks.parsed(made, received="2024-01-03 00:00:00")).where("price < 1e300").collect())
    assert got == sorted((a, b, c or 0) for a, b, c in filter(None, cases.values()))
