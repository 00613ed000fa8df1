"""Numeric helpers and parsers of numbers as they stand in pages and feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def steady(x: Column | str, places: int = 4) -> Column:
    """Rounded half up, with a small bias that absorbs the order of summation, so that other engines agree."""
    scale = float(10**places)
    return F.floor(col(x) * scale + 0.5 + 1e-6).cast("double") / scale


def steady_sql(x: str, places: int = 4) -> str:
    scale = f"1e{places}"
    return f"floor(({x}) * {scale} + 0.5 + 1e-6) / {scale}"


def finite(x: Column | str) -> Column:
    """NaN and infinities to null."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def falsy(x: Column | str, *others: Column | str) -> Column:
    """The first value that is neither null nor 0, as in ``a or b`` for numbers; the last one as it is."""
    every = [col(x), *map(col, others)]
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in every[:-1]), every[-1])


def first_present(*columns: Column | str) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in columns))


def safe_float(text: Column | str) -> Column:
    """``1,5 %`` to 1.5: a decimal comma, blanks and signs of currency and percent are dropped; dashes and N/A are null."""
    kept = F.regexp_replace(F.replace(col(text), F.lit(","), F.lit(".")), "[\\s%€$  ]", "")
    return finite(F.when(~kept.isin("", "N/A", "-", "—", "–"), kept.try_cast("double")))


def safe_int(text: Column | str) -> Column:
    return safe_float(text).try_cast("bigint")


def magnitude(text: Column | str) -> Column:
    """``$1,234.5M`` to 1234500000.0: commas are dropped, a letter B, M, T or K scales (the first of that order counts)."""
    kept = F.regexp_replace(F.upper(col(text)), "[^0-9.,MBTK%-]", "")
    scale = F.when(kept.contains("B"), 1e9).when(kept.contains("M"), 1e6).when(kept.contains("T"), 1e12).when(kept.contains("K"), 1e3).otherwise(1.0)
    return F.regexp_replace(kept, "[^0-9.-]", "").try_cast("double") * scale


def french_number(text: Column | str) -> Column:
    """``1 234,5 €`` to 1234.5."""
    kept = F.replace(F.regexp_replace(col(text), "[€$%\\sA-Za-z  ]", ""), F.lit(","), F.lit("."))
    return F.when(~kept.isin("", "-"), kept.try_cast("double"))


def percent_ratio(text: Column | str) -> Column:
    """``0,20 %`` to 0.002."""
    return safe_float(text) / 100


def currency_amount(text: Column | str) -> Column:
    """``85,42 Mrd. EUR`` to 85420000000.0."""
    number = F.replace(F.regexp_extract(col(text), "(-?[0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    t = F.lower(col(text))
    return number * F.when(t.rlike("mrd|billion|[0-9] ?b\\b"), 1e9).when(t.rlike("mio|million|[0-9] ?m\\b"), 1e6).otherwise(1.0)


def first_number(text: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(col(text), F.lit("-?[0-9]+(?:\\.[0-9]+)?"), F.lit(0)), F.lit(1)).try_cast("double")


def last_number(text: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(col(text), F.lit("-?[0-9]+(?:\\.[0-9]+)?"), F.lit(0)), F.lit(-1)).try_cast("double")


def plain_number(x: Column | str) -> Column:
    """At most four decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", col(x)), "0+$", ""), "\\.$", "")


def padded_ticker(ticker: Column | str) -> Column:
    """A numeric ticker of at most five digits gets five."""
    t = col(ticker)
    return F.when(t.rlike("^[0-9]{1,5}$"), F.lpad(t, 5, "0")).otherwise(t)


def growth(first: Column, last: Column, years: Column) -> Column:
    """Compound annual growth; null where it has no meaning."""
    return F.when((first > 0) & (last > 0) & (years > 0), F.pow(last / first, F.lit(1.0) / years) - 1)
