"""All queries over the driver's tables and their SQL, gathered from the modules of this subpackage."""

from __future__ import annotations

from . import assets, bars, cards, connectors, feeds, fundamentals, identity, indicators, logs, news, quality, search, streams, valuation

FLAGSHIP = "bars_hourly"
_MODULES = [bars, indicators, valuation, quality, logs, identity, assets, news, fundamentals, search, streams, feeds, connectors, cards]


def queries() -> dict:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
