"""Names of companies and markets, and pieces of texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

#: Market names as one source writes them, and as others do. Fixed values.
MARKET_NAMES = {"HKSE": "Hong Kong Stock Exchange", "JPX": "Tokyo Stock Exchange", "VAN": "TSX", "TSXV": "TSX", "ASX": "Australian", "Other OTC": "OTCMKTS", "EURONEXT PARIS": "Paris"}
#: What a market name holds: the name it stands for. Fixed values.
MARKET_PARTS = [("NASDAQ", "NASDAQ"), ("LSE", "London"), ("Stockholm", "Frankfurt")]


def before_comma(name: Column | str) -> Column:
    """``Apple, Inc.`` to ``Apple``."""
    return F.substring_index(col(name), ", ", 1)


def plain_company(name: Column | str) -> Column:
    """Without ``Limited``, commas and a full stop at the end."""
    return F.trim(F.regexp_replace(F.replace(F.replace(col(name), F.lit("Limited"), F.lit("")), F.lit(","), F.lit("")), r"\.$", ""))


def short_company(name: Column | str) -> Column:
    """``Limited`` as ``Ltd``, without commas, full stops and accents."""
    short = F.replace(F.replace(F.replace(col(name), F.lit("Limited"), F.lit("Ltd")), F.lit(","), F.lit("")), F.lit("."), F.lit(""))
    return without_accents(short)


def _marked_letters() -> tuple[str, str]:
    """The letters with marks whose canonical decomposition begins with an ASCII letter, and those letters."""
    every = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(c, base) for c, base in every if base.isascii() and c != base]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _marked_letters()


def without_accents(text: Column | str) -> Column:
    """Letters without their marks, as in the canonical decomposition; other characters beyond ASCII go."""
    return F.regexp_replace(F.translate(col(text), MARKED, BARE), "[^\\x00-\\x7F]", "")


def market_name(name: Column | str) -> Column:
    n = col(name)
    table = F.create_map(*(F.lit(x) for pair in MARKET_NAMES.items() for x in pair))
    known = F.coalesce(F.try_element_at(table, n), n)
    out = known
    for part, stands_for in reversed(MARKET_PARTS):
        out = F.when(known.contains(part), stands_for).otherwise(out)
    return out


def last_segment(url: Column | str) -> Column:
    """What stands after the last slash of an address, whether or not it ends with one."""
    return F.substring_index(F.regexp_replace(col(url), "/$", ""), "/", -1)


def swapped(text: Column | str, separator: str) -> Column:
    """``a:b`` to ``b:a``; null where there is no separator."""
    parts = F.split(col(text), f"\\Q{separator}\\E")
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, 1), F.lit(separator), F.get(parts, 0)))


def between(text: Column | str, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the first ``end`` after it."""
    rest = F.when(col(text).contains(start), F.substring_index(F.regexp_replace(col(text), f"(?s)^.*?\\Q{start}\\E", ""), end, 1))
    return F.when(F.regexp_replace(col(text), f"(?s)^.*?\\Q{start}\\E", "").contains(end), rest)


def every_group(text: Column | str, pattern: str, groups: int) -> Column:
    """The groups of all matches, match by match."""
    found = F.array(*(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)))
    matches = F.sequence(F.lit(1), F.size(F.get(found, 0)))
    return F.when(F.size(F.get(found, 0)) > 0, F.flatten(F.transform(matches, lambda i: F.transform(found, lambda g: F.element_at(g, i))))).otherwise(F.array().cast("array<string>"))
