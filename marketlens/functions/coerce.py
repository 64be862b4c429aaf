"""Scalar columns: text to numbers and dates, growth rates, verdicts and bands. All built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Percent signs, plus signs, commas and white space go; what is no number then is null."""
    return F.nullif(F.regexp_replace(F.trim(text), "[%+,]", ""), F.lit("")).try_cast("double")


def to_whole(text: Column, default: int = 0) -> Column:
    return F.coalesce(to_number(text).cast("long"), F.lit(default).cast("long"))


def to_day(text: Column) -> Column:
    """ISO date first, then `05 Mar 2026` with or without a weekday, then `05-03-2026`."""
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(text, r"(\d{2} [A-Z][a-z]{2} \d{4})", 1), "dd MMM yyyy"), F.try_to_date(F.substring(text, 1, 10), "dd-MM-yyyy"))


def growth(now: str | Column, before: str | Column) -> Column:
    """Percent growth; null unless both are above zero."""
    now, before = (F.col(x) if isinstance(x, str) else x for x in (now, before))
    return F.when((now > 0) & (before > 0), (now - before) / before * 100)


def change(first: Column, last: Column) -> Column:
    """Percent change against the first's size; null at zero."""
    return F.try_divide(last - first, F.abs(first)) * 100


def verdict(value: Column, seen: Column, least: int, low: float, high: float) -> Column:
    """insufficient, out_of_band or ok (bounds included)."""
    return F.when((seen < least) | value.isNull(), "insufficient").when(~value.between(low, high), "out_of_band").otherwise("ok")


def band(value: Column, cuts: list[tuple[float, str]], last: str, unknown: str) -> Column:
    """The name of the first cut that lies above the value."""
    found = F.when(value.isNull() | F.isnan(value), unknown)
    for cut, name in cuts:
        found = found.when(value < cut, name)
    return found.otherwise(last)


def liquidity(value: Column) -> Column:
    return band(value, [(1, "illiquid"), (5, "thin"), (25, "adequate")], "liquid", "unknown")


def move(value: Column) -> Column:
    return band(F.abs(value), [(5, "quiet"), (12, "material")], "severe", "unmeasured")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "Critical", 0).when(severity == "High", 1).when(severity == "Medium", 2).otherwise(3)


def dedup_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", ""))


def clauses(text: Column) -> Column:
    """Parts of a headline between dashes, bars and semicolons; empty parts go. Without a part, the headline itself."""
    parts = F.filter(F.transform(F.split(text, r"\s*[;–—]\s*|\s+-\s+|\s*\|\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).when(text != "", F.array(text)).when(text == "", F.array().cast("array<string>"))


# fixed values: stamps of the two exchanges' filings, in the order in which they are tried, and the form in which they are shown
NSE_STAMPS = ("d-MMM-yyyy H:m:s", "d-MMM-yyyy", "yyyy-M-d H:m:s", "yyyy-M-d")
BSE_STAMPS = ("yyyy-M-d H:m:s", "yyyy-M-d", "d MMM yyyy H:m:s", "d MMM yyyy", "d-MMM-yyyy H:m:s", "d/M/yyyy")
SHOWN = "dd MMM yyyy"
EXACT_BELOW = 1e12


def _shown(raw: Column, text: Column, stamps: tuple[str, ...]) -> Column:
    day = F.coalesce(*[F.try_to_date(F.regexp_replace(text, r"\s+", " "), s) for s in stamps])
    return F.coalesce(F.date_format(day, SHOWN), raw, F.lit(""))


def nse_stamp(text: Column) -> Column:
    """The day of a stamp as `05 Mar 2026`; a stamp of no known form as it stands, null as empty."""
    return _shown(text, text, NSE_STAMPS)


def bse_stamp(text: Column) -> Column:
    """As nse_stamp, after T stands for a space, fractions of seconds and Z go."""
    cut = F.trim(F.replace(F.substring_index(F.replace(text, F.lit("T"), F.lit(" ")), ".", 1), F.lit("Z"), F.lit("")))
    return _shown(text, cut, BSE_STAMPS)


def fixed(x: Column, digits: int) -> Column:
    """A number with one or two digits after the point, rounded by its exact binary value, true ties to even.

    2.675 is a little under its tie and gives 2.67; 0.125 is one and gives 0.12. A negative number keeps its sign when all
    digits are zero. Of x * 2 * 10^digits the part that a double cannot hold is worked out as well, so that what lies beside
    a tie is told from one. From a million millions on the shortest decimal form is rounded; what isn't finite gives null.
    """
    if digits not in (1, 2):
        raise ValueError("one or two digits")
    scale = 10**digits
    size, twice = F.abs(x.cast("double")), F.lit(2.0 * scale)
    spread = size * F.lit(134217729.0)
    high = spread - (spread - size)  # the upper half of the digits, so that both products below are exact
    product = size * twice
    rest = (high * twice - product) + (size - high) * twice
    whole = F.floor(product)
    sharp = product == whole.cast("double")
    under = F.when(sharp & (rest < 0), whole - 1).otherwise(whole)
    half = F.floor(under / 2)
    even = F.when(sharp & (rest == 0), half + half % 2).otherwise(half + 1)
    parts = F.when(under % 2 == 0, half).otherwise(even)
    text = F.concat(F.floor(parts / scale).cast("string"), F.lit("."), F.lpad((parts % scale).cast("string"), digits, "0"))
    sign = F.when(x.cast("double").cast("string").startswith("-"), "-").otherwise("")
    near = F.when(size < EXACT_BELOW, F.concat(sign, text)).otherwise(F.format_string(f"%.{digits}f", x.cast("double")))
    return F.when(~F.isnan(x.cast("double")) & (size < float("inf")), near)


def wire_money(x: Column) -> Column:
    return fixed(x, 2)


def wire_percent(x: Column) -> Column:
    """With a sign before what is more than zero."""
    return F.concat(F.when(x > 0, "+").otherwise(""), fixed(x, 1), F.lit("%"))
