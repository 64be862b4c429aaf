"""Columns that read figures and fields out of HTML and raw records. Patterns alone, no parser: each reads one fragment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.coerce import to_number


def decoded(text: Column) -> Column:
    """The common character references as the characters they stand for."""
    for name, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def plain(html: Column) -> Column:
    """Text of a fragment: tags go, the common character references are read, white space is one space."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, "<[^>]*>", " ")), r"\s+", " "))


def section(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<section\b[^>]*\bid\s*=\s*[\"']?{name}\b[^>]*>(.*?)</section>", 1)


def _cells(row: Column) -> Column:
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), plain)


def row_values(html: Column, name: str, label: str) -> Column:
    """Of a section's first row whose first cell matches the label: the numbers of its other cells."""
    rows = F.transform(F.regexp_extract_all(section(html, name), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), _cells)
    row = F.try_element_at(F.filter(rows, lambda r: (F.size(r) > 0) & F.try_element_at(r, F.lit(1)).rlike(label)), F.lit(1))
    numbers = F.transform(F.slice(row, 2, 10_000), lambda c: F.regexp_replace(c, "[,%]", "").try_cast("double"))
    return F.coalesce(F.filter(numbers, lambda x: x.isNotNull()), F.array().cast("array<double>"))


#: Columns of a peer table by what their headings begin with or hold.
PEER_COLUMNS = {"sales_var_pct": "sales var", "market_cap": "^mar cap|market cap", "sales_qtr": "^sales qtr", "profit_var_pct": "profit var", "np_qtr": "^np qtr", "pe_ratio": "^p/e", "roce": "^roce"}


def peer_rows(html: Column) -> Column:
    """A peer table's rows: name, ticker (from the link) and the figures, whose columns are found by their headings."""
    heads = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<th\b[^>]*>(.*?)</th>"), F.lit(1)), lambda h: F.lower(plain(h)))
    place = lambda pattern: F.aggregate(F.transform(heads, lambda h, i: F.when(h.rlike(pattern), i + 1)), F.lit(None).cast("int"), lambda last, x: F.coalesce(x, last))
    raw = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)))
    name = place("^name")
    figure = lambda cells, pattern: F.regexp_replace(plain(F.try_element_at(cells, F.coalesce(place(pattern), F.lit(100_000)))), "[,%]", "").try_cast("double")

    def made(cells: Column) -> Column:
        link = F.try_element_at(cells, F.coalesce(name, F.lit(100_000)))
        ticker = F.upper(F.regexp_extract(link, r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']/*company/([^/\"']+)", 1))
        title = plain(F.regexp_extract(link, r"(?is)<a\b[^>]*>(.*?)</a>", 1))
        return F.struct(title.alias("name"), ticker.alias("ticker"), *[figure(cells, p).alias(c) for c, p in PEER_COLUMNS.items()])

    return F.filter(F.transform(raw, made), lambda r: (r["name"] != "") & (r["ticker"] != ""))


def first_present(*columns: str) -> Column:
    """The first of several spellings of a field that is not empty; else an empty text."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns], F.lit(""))


def isin(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\bIN[A-Z0-9]{9}[0-9]\b", 0), F.lit(""))


def shortened(text: Column, most: int = 240) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)


def feed_title(title: Column) -> Column:
    """What stands before the first " - "."""
    return F.element_at(F.split(plain(title), " - "), 1)


def feed_source(title: Column, source: Column) -> Column:
    """What stands after the last " - " of the title, else the feed's source."""
    return F.when(title.contains(" - "), F.element_at(F.split(title, " - "), -1)).otherwise(F.coalesce(source, F.lit("Finance Media")))


def feed_summary(summary: Column) -> Column:
    return F.trim(F.regexp_replace(plain(summary), r"(?i)(\.\.\.|read more.*)", ""))


def exchange_day(raw: Column) -> Column:
    """Exchange stamps as '14 Aug 2026'; what has another form stays as it is."""
    day = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in ("dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    return F.coalesce(F.date_format(day, "dd MMM yyyy"), raw, F.lit(""))


def filings(raw, holdings):
    """Announcements (aliased fields) joined to holdings (symbol, name, sector): company, industry, filing, date, link, held.

    Rows without a symbol or a subject go; companies that are not held stay, as 'Corporate' where no industry is told.
    """
    rows = raw.select(
        F.upper(first_present("symbol")).alias("symbol"), first_present("attchmntText", "desc", "subject").alias("subject"), first_present("sm_name", "company").alias("told"),
        first_present("smIndustry", "industry").alias("field"), first_present("an_dt", "date").alias("stamp"), first_present("attchmntFile", "attachment").alias("link"),
    ).where("symbol <> '' and subject <> ''")
    known = holdings.select(F.upper("symbol").alias("symbol"), F.col("name").alias("own"), "sector")
    joined = rows.join(F.broadcast(known), "symbol", "left")
    return joined.select(
        "symbol", F.coalesce(F.nullif("own", F.lit("")), F.nullif("told", F.lit("")), "symbol").alias("company"), F.coalesce("sector", F.nullif("field", F.lit("")), F.lit("Corporate")).alias("industry"),
        shortened(F.col("subject")).alias("filing"), exchange_day(F.col("stamp")).alias("date"), "link", F.col("sector").isNotNull().alias("held"),
    )


def owner_earnings(quarter_profit: Column, debt: Column, capex: Column) -> Column:
    """A year's profit and a depreciation of 8 percent of debt, less capital expenditure."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.round(zero(quarter_profit) * 4 + zero(debt) * 0.08 - zero(capex), 1)


def numbers(texts: Column, strict: bool = False) -> Column:
    """A series of texts as numbers: those that are none go, or (strict) take the whole series with them."""
    read = F.transform(texts, to_number)
    return F.when(F.exists(read, lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(read) if strict else F.filter(read, lambda x: x.isNotNull())


def last_of(values: Column, n: int = 4) -> Column:
    """The last n of a series; n zeros for an empty one."""
    return F.when(F.size(values) == 0, F.array_repeat(F.lit(0.0), n)).otherwise(F.slice(values, F.greatest(F.lit(1), F.size(values) - (n - 1)), F.lit(n)))
