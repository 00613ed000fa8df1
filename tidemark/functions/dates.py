"""Dates as feeds write them, in English and French. ``now`` is always given, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

ENGLISH = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: French month names and their short forms by number. Fixed values.
FRENCH = {
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11,
    "décembre": 12, "decembre": 12,
}


def _ago(text: Column, pattern: str, unit: str, now: str) -> Column:
    n = F.regexp_extract(text, pattern, 1).try_cast("int")
    none = F.lit(0)
    days = n * 7 if unit == "weeks" else n if unit == "days" else none
    step = F.make_dt_interval(days, n if unit == "hours" else none, n if unit == "mins" else none)
    return F.when(n.isNotNull(), F.lit(now).cast("timestamp_ntz") - step)


def _day(year: Column, month: Column, day: Column) -> Column:
    written = F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string"))
    return F.try_to_date(written, "y-M-d").cast("timestamp_ntz")


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def english_date(text: Column | str, now: str) -> Column:
    """``3 hours ago``, ``Jan 15, 2025``, ``May 16`` (of this year)."""
    s = F.lower(F.trim(col(text)))
    full, short = r"^([a-z]+)\s+(\d{1,2}),?\s*(\d{4})", r"^([a-z]+)\s+(\d{1,2})$"
    month = lambda p: F.nullif(F.array_position(F.array(*map(F.lit, ENGLISH)), F.substring(F.regexp_extract(s, p, 1), 1, 3)), F.lit(0))
    this_year = F.year(F.lit(now).cast("date"))
    return F.coalesce(
        *(_ago(s, rf"^(\d+)\s+{word}s?\s+ago", unit, now) for word, unit in (("hour", "hours"), ("minute", "mins"), ("day", "days"), ("week", "weeks"))),
        _day(_number(s, full, 3), month(full), _number(s, full, 2)),
        _day(this_year, month(short), _number(s, short, 2)),
    )


def french_date(text: Column | str, now: str) -> Column:
    """ISO, ``16/05/2026``, ``il y a 2 h``, ``hier`` (at noon), ``15 mai 2026``, ``15 mai`` (of this year)."""
    s = F.lower(F.trim(col(text)))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.upper(F.trim(col(text)))).cast("timestamp_ntz"))
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    named = r"(\d{1,2})\s+(" + "|".join(FRENCH) + r")\s*(\d{4})?"
    months = F.create_map(*(F.lit(x) for pair in FRENCH.items() for x in pair))
    month = F.try_element_at(months, F.regexp_extract(s, named, 2))
    yesterday = F.date_sub(F.lit(now).cast("date"), 1).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(12))
    return F.coalesce(
        iso,
        _day(_number(s, slashed, 3), _number(s, slashed, 2), _number(s, slashed, 1)),
        _ago(s, r"^il y a (\d+)\s*h", "hours", now),
        _ago(s, r"^il y a (\d+)\s*min", "mins", now),
        _ago(s, r"^il y a (\d+)\s*jour", "days", now),
        F.when(s.contains("hier"), yesterday),
        _day(F.coalesce(_number(s, named, 3), F.year(F.lit(now).cast("date"))), month, _number(s, named, 1)),
    )


def epoch_time(seconds: Column | str) -> Column:
    return F.timestamp_seconds(col(seconds))


def us_date(text: Column | str) -> Column:
    return F.try_to_date(col(text), "M/d/y")


def quarter_label(date: Column | str) -> Column:
    """``2024Q3``."""
    d = col(date)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
