"""Whole pages as records: a company's figures, and the companies that an approval page names.

A page's markup is cut once into sections, rows and cells; figures are then looked up in that one array, by section and
label, so that a page of many figures is not searched once for each. Elements that are not closed end where the next of
their kind begins, so no cell takes over its neighbour's text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.coerce import change
from marketlens.functions.extract import decoded, plain
from marketlens.operators.sets import top_of

# fixed values: what the label of a ratio holds, in the order in which it is asked
RATIOS = (("market cap", "market_cap"), ("current price", "current_price"), ("stock p/e", "pe_ratio"), ("roce", "roce"), ("roe", "roe"), ("debt to equity", "debt_to_equity"), ("dividend yield", "dividend_yield"))
# fixed values: research spending assumed of a sector, in percent of sales
RESEARCH = (("semiconductors_equipment", 8.5), ("aerospace_defence", 6.2), ("cybersecurity", 10.5), ("clean_energy", 3.0))
RESEARCH_ELSE = 1.5
CAPEX_SHARE = 0.05
# fixed values: sectors that an approval page may tell of, first come first; headings that are no names; forms of firms
APPROVED_SECTORS = ("automobile", "auto components", "white goods", "it hardware", "textile", "telecom", "solar", "drone", "pharmaceutical", "medical devices", "food processing", "specialty steel")
HEADINGS = ("company", "company name", "s. no.", "s.no", "name", "applicant")
FIRM = ("Ltd", "Limited", "Corp", "Corporation", "Enterprises", "Solutions", "Electronics", "Industries", "Apparels", "Defence", "Semiconductors", "Company")
HEAD = 500

# possessive, so that the length of a run costs no stack
_MARKUP = r"(?:<[^>]*>)++"
_CAPITALISED = r"(?U)\b[A-Z][a-zA-Z0-9&]+(?:\s+[A-Z][a-zA-Z0-9&]+)*+\w*+"


def elements(html: Column, names: str, ends: str = "") -> Column:
    """The insides of the named elements, up to their end, the next of the same names, or one of ``ends``."""
    stop = "".join(f"|</(?:{e})\\b" for e in [ends] if e)
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{names})\b[^>]*>(.*?)(?=<(?:{names})\b|</(?:{names})\b{stop}|\z)"), F.lit(1))


def visible(html: Column) -> Column:
    """All text of a page as it stands, with one space where markup was; scripts, styles and remarks go."""
    shown = F.regexp_replace(html, r"(?is)<(script|style|template)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", "<>")
    return decoded(F.regexp_replace(F.regexp_replace(shown, rf"^{_MARKUP}|{_MARKUP}\z", ""), _MARKUP, " "))


def joined(html: Column) -> Column:
    """A fragment's pieces of text, each trimmed, joined without a space."""
    return F.concat_ws("", F.transform(F.split(html, _MARKUP), lambda x: F.regexp_replace(decoded(x), r"(?U)^\s+|\s+$", "")))


def firms(text: Column) -> Column:
    """Runs of capitalised words, each up to the last word that is a form of firm; runs without one go."""
    upto = lambda run: F.regexp_extract(run, rf"(?Us)^(.*\s(?:{'|'.join(FIRM)}))\b", 1)
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_CAPITALISED), F.lit(0)), upto), lambda x: x != "")


def table_rows(html: Column) -> Column:
    """Every row with cells: section, label (the text of the first cell), values (the other cells that are numbers)."""
    sections = F.regexp_extract_all(html, F.lit(r"(?is)(<section\b[^>]*>.*?)(?=<section\b|</section>|\z)"), F.lit(1))

    def rows(part: Column) -> Column:
        name = F.regexp_extract(part, r"(?is)^<section\b[^>]*?\bid\s*=\s*[\"']?([^\"'\s>]+)", 1)
        cells = F.filter(F.transform(elements(part, "tr", "table"), lambda r: elements(r, "td")), lambda c: F.size(c) > 0)
        return F.transform(cells, lambda c: F.struct(name.alias("section"), plain(F.get(c, F.lit(0))).alias("label"), F.filter(F.transform(F.slice(c, 2, 100_000), lambda x: F.nullif(F.regexp_replace(joined(x), "[,%]", ""), F.lit("")).try_cast("double")), lambda x: x.isNotNull()).alias("values")))

    return F.flatten(F.transform(sections, rows))


def series(rows: Column, section: str, label: str) -> Column:
    """The values of the section's first row whose label the pattern meets; empty if there is none."""
    found = F.filter(rows, lambda r: (r["section"] == section) & r["label"].rlike(label))
    return F.coalesce(F.get(found, F.lit(0))["values"], F.array().cast("array<double>"))


def ratio_list(html: Column) -> Column:
    """The list of top ratios as kind and number; what is no number, or of no known label, goes. The last of a kind counts."""
    part = F.regexp_extract(html, r"(?is)<div\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?<![\w-])company-ratios(?![\w-])[^\"']*[\"'][^>]*>(.*?)(?=</ul>|<section\b|\z)", 1)
    span = lambda li, name: joined(F.regexp_extract(li, rf"(?is)<span\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</span>", 1))

    def read(li: Column) -> Column:
        label = F.lower(span(li, "name"))
        kind = reduce(lambda c, r: c.when(label.contains(r[0]), r[1]), RATIOS[1:], F.when(label.contains(RATIOS[0][0]), RATIOS[0][1]))
        return F.struct(kind.alias("kind"), F.nullif(F.replace(span(li, "number"), F.lit(","), F.lit("")), F.lit("")).try_cast("double").alias("number"))

    return F.filter(F.transform(elements(part, "li"), read), lambda r: r["kind"].isNotNull() & r["number"].isNotNull())


def _back(values: Column, n: int) -> Column:
    return F.get(values, F.size(values) - n)


def _newest(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - (n - 1)), F.lit(n))


def company_figures(pages: DataFrame) -> DataFrame:
    """pages (ticker, sector, html) -> a row for each, with ratios, newest figures, changes and trends; unknown ones are null.

    Without a row for capital expenditure it is estimated from four times the quarter's sales; without one for research,
    ``rd_pct`` is the sector's. A row of pledged shares that is absent means not disclosed, not none. Null or empty pages
    give nulls (and the estimates); rows are told apart by place, so tickers may repeat.
    """
    html = F.coalesce("html", F.lit(""))
    cut = pages.select("ticker", "sector", table_rows(html).alias("rows"), ratio_list(html).alias("ratios"))
    named = {"sales": ("quarters", "Sales"), "opm": ("quarters", "OPM"), "eps": ("quarters", "EPS"), "profit": ("quarters", "Net Profit"), "year_opm": ("profit-loss", "OPM"), "year_sales": ("profit-loss", "Sales"), "debt": ("balance-sheet", "Borrowings"),
             "cash": ("cash-flow", "Cash from Operating Activity"), "assets": ("cash-flow", "Fixed assets purchased"), "research": ("profit-loss", r"R&D"), "research_2": ("profit-loss", "Research"), "roces": ("ratios", "ROCE"),
             "promoter": ("shareholding", "Promoters"), "fii": ("shareholding", "FIIs"), "dii": ("shareholding", "DIIs"), "pledged": ("shareholding", "Pledg")}
    read = cut.select("ticker", "sector", "ratios", *[series(F.col("rows"), *at).alias(f"_{n}") for n, at in named.items()])
    s = {n: F.col(f"_{n}") for n in named}
    ratio = lambda kind: F.try_element_at(F.filter("ratios", lambda r: r["kind"] == kind), F.lit(-1))["number"]
    spent = F.coalesce(_back(s["research"], 1), _back(s["research_2"], 1))
    rate = reduce(lambda c, r: c.when(F.col("sector") == r[0], r[1]), RESEARCH[1:], F.when(F.col("sector") == RESEARCH[0][0], RESEARCH[0][1])).otherwise(RESEARCH_ELSE)
    some = lambda n, most: F.when(F.size(s[n]) > 0, _newest(s[n], most))
    step = lambda n, digits: F.bround(_back(s[n], 1) - _back(s[n], 2), digits)
    sum_of = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return read.select(
        "ticker", "sector", *[ratio(kind).alias(kind) for _, kind in RATIOS],
        _back(s["sales"], 1).alias("q_sales"), F.when(F.size(s["sales"]) > 1, F.coalesce(F.bround(change(_back(s["sales"], 2), _back(s["sales"], 1)), 2), F.lit(0.0))).alias("qoq_sales_growth"), some("sales", 8).alias("sales_trend"),
        _back(s["opm"], 1).alias("q_opm"), step("opm", 1).alias("opm_expansion"), some("opm", 4).alias("opm_trend"),
        _back(s["eps"], 1).alias("q_eps"), some("eps", 8).alias("eps_trend"), F.when(F.size(s["eps"]) > 3, F.bround(sum_of(_newest(s["eps"], 4)), 2)).alias("ttm_eps"), _back(s["profit"], 1).alias("q_net_profit"),
        some("year_opm", 5).alias("year_opm_trend"), some("year_sales", 6).alias("annual_sales_trend"), some("debt", 5).alias("debt_trend"), some("cash", 5).alias("cash_flow_trend"),
        F.coalesce(F.abs(_back(s["assets"], 1)), F.bround(F.coalesce(_back(s["sales"], 1), F.lit(0.0)) * 4 * CAPEX_SHARE, 1)).alias("capex"),
        spent.alias("rd_expenditure"), F.when(spent.isNull(), rate).alias("rd_pct"), some("roces", 5).alias("roce_trend"),
        *[c for n in ("promoter", "fii", "dii") for c in (_back(s[n], 1).alias(f"{n}_pct"), step(n, 2).alias(f"{n}_change"))],
        _back(s["pledged"], 1).alias("pledged_pct"), step("pledged", 2).alias("pledged_change"), F.when(F.size(s["pledged"]) > 1, _newest(s["pledged"], 4)).alias("pledged_trend"),
    )


def approvals(pages: DataFrame) -> DataFrame:
    """pages (page_id, title, html, day) -> page_id, place, name, sector, scheme, day: the companies that a page approves.

    Names are the first cells of table rows, then the items of lists, then firms named in the text; numbering goes, as do
    headings and what is too short or too long. Of names that are equal but for case a page's first counts, and pages that
    repeat an id share their names. Sector and scheme are read from the title and the first ``HEAD`` characters.
    """
    html, title = F.coalesce("html", F.lit("")), F.lower(F.coalesce("title", F.lit("")))
    cells = F.flatten(F.transform(elements(html, "table"), lambda t: F.filter(F.transform(elements(t, "tr", "table"), lambda r: joined(F.get(elements(r, "t[dh]"), F.lit(0)))), lambda c: ~F.lower(c).isin(*HEADINGS))))
    items = F.flatten(F.transform(elements(html, "ul"), lambda u: F.transform(elements(u, "li", "ul"), joined)))
    told = F.filter(F.concat(cells, items), lambda c: F.char_length(c).between(4, 99) & ~c.contains("\n"))
    read = pages.select("page_id", "day", "html", title.alias("title"), visible(html).alias("text"))
    cut = read.select("page_id", "day", "title", F.lower(F.substring("text", 1, HEAD)).alias("head"), F.concat(told, firms(F.col("text"))).alias("names"))
    holds = lambda what: F.col("title").contains(what) | F.col("head").contains(what)
    # the outer form, as an inner one has the names' length asked first, for which each page would be read again; pages without names go below
    sector = reduce(lambda c, x: c.when(holds(x), x.title()), APPROVED_SECTORS[1:], F.when(holds(APPROVED_SECTORS[0]), APPROVED_SECTORS[0].title())).otherwise("Manufacturing")
    rows = cut.select("page_id", "day", sector.alias("sector"), F.when(holds("2.0"), "PLI 2.0").otherwise("PLI Scheme").alias("scheme"), F.posexplode_outer("names").alias("place", "name"))
    clean = F.regexp_replace(F.regexp_replace("name", r"(?U)^\d+[.)]\s*", ""), r"(?U)^\s+|\s+$", "")
    rows = rows.withColumn("name", clean).where(F.char_length("name").between(4, 79))
    return rows.groupBy("page_id", F.lower("name").alias("_same")).agg(F.min(F.struct("place", "name", "sector", "scheme", "day")).alias("r")).select("page_id", "r.*")


def radar(found: DataFrame, most: int = 3) -> DataFrame:
    """approvals (page_id, place, name, sector, scheme, day) -> name, n_approvals, first_day, schemes (its first ``most``, in order).

    A name may be on any number of pages: they are counted by partial sums, and a task hands on ``most`` rows of a name.
    """
    order = ["day", "page_id", "place"]
    said = F.concat_ws(" ", "scheme", "sector")
    counts = found.groupBy("name").agg(F.count("*").alias("n_approvals"), F.min("day").alias("first_day"))
    first = top_of(found, ["name"], [F.asc_nulls_last(c) for c in order], most).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("rank", said.alias("said")))).alias("list"))
    return counts.join(first, "name").select("name", "n_approvals", "first_day", F.transform("list", lambda r: r["said"]).alias("schemes"))
