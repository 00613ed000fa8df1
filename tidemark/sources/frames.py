"""Stored socket frames as Spark data sources: ``quote_frames`` reads bars, ``tick_frames`` streams ticks.

A frame is ``~m~LENGTH~m~PAYLOAD``, the length in characters, and a line of a stored file holds one message of frames. Folders and files are
reached by pyarrow's file systems, so their place may be any that the cluster shares. Lines that hold no whole frame, payloads that aren't JSON and bars that lack a price are left out.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import posixpath
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

_HEAD = re.compile(r"~m~(\d+)~m~")
_BLOCK = 1 << 16
PERIODS = 12


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def frames(line: str) -> Iterator[str]:
    """The payloads of a message; a frame that is cut short ends it."""
    at = 0
    while m := _HEAD.search(line, at):
        at = m.end() + int(m[1])
        if at > len(line):
            return
        yield line[m.end() : at]


def bars_of(payload: str) -> Iterator[tuple[int, float, float, float, float, int]]:
    """Epoch seconds, open, high, low, close and volume of the whole bars in a payload."""
    try:
        made = json.loads(payload)
        series = made["p"][1]["sds_1"]["s"] if made.get("m") == "timescale_update" else []
    except (ValueError, LookupError, TypeError, AttributeError):
        return
    for bar in series if isinstance(series, list) else []:
        v = bar.get("v") if isinstance(bar, dict) else None
        if isinstance(v, list) and len(v) >= 5 and all(isinstance(x, (int, float)) and math.isfinite(x) for x in v[:5]):
            volume = v[5] if len(v) > 5 and isinstance(v[5], (int, float)) and math.isfinite(v[5]) else 0
            yield int(v[0]), *map(float, v[1:5]), int(volume)


def bars_asked(days: int, resolution: str) -> int:
    """How many of the newest bars a request over ``days`` asks for."""
    return {"1D": max(10, days), "1W": max(5, days // 7 + 5), "1M": max(5, days // 30 + 5)}[resolution]


class _Files(InputPartition):
    """Files of an asset, the newest period first."""

    def __init__(self, asset: str, files: list[str]) -> None:
        self.asset, self.files = asset, files


class _BarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.start, self.end = (dt.date.fromisoformat(options[k]) if options.get(k) else None for k in ("start", "end"))
        self.most = None
        if self.start is not None and self.end is not None:
            self.most = bars_asked((self.end - self.start).days, options.get("resolution", "1D"))
        self.assets = set(options["assets"].split(",")) if options.get("assets") else None
        self.prune = options.get("prune", "false").lower() == "true"
        self.low: tuple[dt.datetime, bool] | None = None  # bound, and whether it belongs to the range
        self.high: tuple[dt.datetime, bool] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None) if self.prune else None
            if column == ("asset",) and isinstance(f, (EqualTo, In)):
                told = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.assets = told if self.assets is None else self.assets & told
            elif column == ("ts",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                bound = (f.value.replace(tzinfo=None), isinstance(f, GreaterThanOrEqual))
                self.low = bound if self.low is None else max(self.low, bound, key=lambda b: (b[0], not b[1]))
            elif column == ("ts",) and isinstance(f, (LessThan, LessThanOrEqual)):
                bound = (f.value.replace(tzinfo=None), isinstance(f, LessThanOrEqual))
                self.high = bound if self.high is None else min(self.high, bound, key=lambda b: (b[0], b[1]))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """A partition for each asset and PERIODS months or years; where the newest bars have to be counted, one for each asset."""
        system, root = place(self.path)
        out = []
        for folder in system.get_file_info(fs.FileSelector(root)):
            asset = unquote(folder.base_name.partition("asset=")[2])
            if folder.type != fs.FileType.Directory or not asset or (self.assets is not None and asset not in self.assets):
                continue
            periods: dict[str, list[str]] = {}
            for f in system.get_file_info(fs.FileSelector(folder.path, recursive=True)):
                period = posixpath.basename(posixpath.dirname(f.path)).partition("period=")[2]
                if f.type == fs.FileType.File and period and not f.base_name.startswith(("_", ".")) and self._may_hold(period):
                    periods.setdefault(period, []).append(f.path)
            newest = [sorted(periods[p]) for p in sorted(periods, reverse=True)]
            step = max(1, len(newest)) if self.most is not None else PERIODS
            out += [_Files(asset, [f for files in newest[i : i + step] for f in files]) for i in range(0, len(newest), step)]
        return out or [_Files("", [])]

    def _may_hold(self, period: str) -> bool:
        """By its period; what is newer than the range is still counted where bars are."""
        low = max((x for x in (self.low and self.low[0].strftime("%Y-%m"), self.start and self.start.strftime("%Y-%m")) if x), default="")
        high = min((x for x in (self.high and self.high[0].strftime("%Y-%m"), self.end and self.end.strftime("%Y-%m")) if x), default="9999-99")
        return period >= low[: len(period)] and (self.most is not None or period <= high[: len(period)])

    def _told(self, ts: dt.datetime) -> bool:
        if self.low is not None and (ts < self.low[0] or (ts == self.low[0] and not self.low[1])):
            return False
        if self.high is not None and (ts > self.high[0] or (ts == self.high[0] and not self.high[1])):
            return False
        return (self.start is None or ts.date() >= self.start) and (self.end is None or ts.date() <= self.end)

    def read(self, partition: _Files) -> Iterator[tuple]:
        """Bars of one period are in memory at a time; of bars with one time the last stands."""
        system, _ = place(self.path)
        by_period: dict[str, list[str]] = {}
        for f in partition.files:
            by_period.setdefault(posixpath.dirname(f), []).append(f)
        left = self.most
        for files in by_period.values():
            bars: dict[int, tuple] = {}
            for f in files:
                with system.open_input_stream(f) as raw:
                    for line in _lines(raw):
                        bars.update((b[0], b[1:]) for payload in frames(line) for b in bars_of(payload))
            for at in sorted(bars, reverse=True)[:left]:
                ts = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=at)
                if self._told(ts):
                    yield partition.asset, ts, *bars[at]
            if left is not None:
                left -= min(left, len(bars))
                if not left:
                    return


def _lines(raw) -> Iterator[str]:
    """Lines of a stream, read by blocks."""
    held = b""
    while block := raw.read(_BLOCK):
        *whole, held = (held + block).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in whole)
    if held:
        yield held.decode("utf-8", "replace")


class QuoteFrames(DataSource):
    """Bars (asset, ts, open, high, low, close, volume) from ``path/asset=A/period=P/*``.

    P is a month (yyyy-MM) or a year, whose bars the folder holds. Options: path; assets, parted by commas; start and end (days, both included), of which only the newest bars that a request over them asks for by resolution (1D, 1W, 1M) are told. With prune, filters on
    asset and ts choose folders and rows in the reader; Spark keeps what one query pushed for the next query of the same DataFrame that pushes nothing, so such a DataFrame must
    serve one query only, and the default is not to.
    """

    @classmethod
    def name(cls) -> str:
        return "quote_frames"

    def schema(self) -> str:
        return "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume long"

    def reader(self, schema) -> DataSourceReader:
        return _BarReader(dict(self.options))


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class _TickReader(DataSourceStreamReader):
    """An offset is a file's name and how many bytes of it were read; files come in the order of their names and only the last may still grow, by whole lines."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"file": "", "bytes": 0}

    def _files(self) -> list[fs.FileInfo]:
        system, root = place(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)

    def latestOffset(self) -> dict:
        files = self._files()
        return {"file": files[-1].base_name, "bytes": self._whole(files[-1])} if files else self.initialOffset()

    def _whole(self, file: fs.FileInfo) -> int:
        """Bytes up to the last end of a line."""
        system, _ = place(self.path)
        end = file.size
        with system.open_input_file(file.path) as raw:
            while end > 0:
                start = max(0, end - _BLOCK)
                at = raw.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for f in self._files():
            if start["file"] <= f.base_name <= end["file"]:
                first = start["bytes"] if f.base_name == start["file"] else 0
                last = end["bytes"] if f.base_name == end["file"] else f.size
                if first < last:
                    out.append(_Range(f.path, first, last))
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, _ = place(self.path)
        with system.open_input_file(partition.file) as raw:
            at, held = partition.start, b""
            while at < partition.end:
                block = raw.read_at(min(_BLOCK, partition.end - at), at)
                at += len(block)
                *whole, held = (held + block).split(b"\n")
                for line in whole:
                    yield from ((payload,) for payload in frames(line.decode("utf-8", "replace")))
            if held:
                yield from ((payload,) for payload in frames(held.decode("utf-8", "replace")))

    def commit(self, end: dict) -> None:
        pass


class TickFrames(DataSource):
    """Payloads (json) of the frames in the files of ``path``, as a stream that can be taken up again at any offset."""

    @classmethod
    def name(cls) -> str:
        return "tick_frames"

    def schema(self) -> str:
        return "json string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TickReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(QuoteFrames)
    spark.dataSource.register(TickFrames)
