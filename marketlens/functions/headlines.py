"""Columns over headlines: tokens, event types, certainty and amounts of money."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word lists and patterns that results must agree with
TOKEN = "[A-Za-z0-9&.']+"
PERSON_TITLES = "mr mrs ms dr shri smt sri prof ceo cto cfo coo cmd md chairman chairperson founder president director minister justice governor".split()
CORPORATE = "ltd limited inc corp corporation india industries shares share stock stocks".split()
HEADLINE_VERBS = (
    "wins bags secures launches unveils announces reports posts zooms surges jumps falls gains rallies acquires partners expands confirms says plans "
    "eyes inks signs gets buys sells hits rises climbs slips drops soars delivers commissions starts begins opens"
).split()
FUNCTION_WORDS = "for with and or to in on at of from by as after over amid into via against under up down the a an its his her their".split()
PERIOD = r"^(q[1-4]|h[12]|fy\d{2,4}|cy\d{2,4}|9m|1h|2h)$"
EVENTS = {
    "tie_up": ("joint venture", "strategic partnership", "partnership with", "partners with", "ties up with", "tie-up with", "joins hands", "alliance with", "mou with", "memorandum of understanding", "collaboration with", "technology transfer"),
    "acquisition": ("acquires", "acquisition of", "buys stake", "stake purchase", "to acquire", "takeover of", "merger with"),
    "order_win": ("wins order", "bags order", "secures order", "wins contract", "bags contract", "order worth", "letter of intent", "purchase order"),
    "capacity_add": (
        "new plant", "new facility", "new factory", "groundbreaking", "capacity expansion", "expands capacity", "commercial production", "begins production", "starts production", "commissions",
        "sets up plant", "sets up unit", "multiyear commitment", "billion deal", "billion commitment",
    ),
    "supply_disruption": ("shortage", "supply crunch", "supply chain disruption", "export restriction", "export curb", "export ban", "halts production", "production halt", "plant shutdown", "force majeure", "embargo", "supply constraints"),
    "input_cost_shock": ("prices surge", "prices soar", "prices spike", "prices jump", "price surge", "cost surge", "raw material cost", "freight rates", "input costs rise", "costlier imports"),
}
RISKS = ("supply_disruption", "input_cost_shock")
NEGATIONS = ("denies", "rules out", "no plans", "refutes", "dismisses report", "calls off", "cancels", "scraps", "shelves")
REPORTED = ("reportedly", "reports of", "report says", "sources say", "rumour", "rumor", "speculation", "likely to", "could ", "may ", "in talks", "exploring", "mulls", "weighing", "considering")
ANNOUNCED = ("intention to", "intends to", "plans to", "planning to", "proposed", "proposes", "set to", "to acquire", "to buy", "agreed to", "in principle", "signs mou", "mou with", "memorandum of understanding")
COMMENTARY = (
    "stocks rally", "stock rally", "shares rally", "stocks gain", "stocks jump", "stocks surge", "stocks slip", "stocks fall", "shares jump", "shares surge", "share price", "top gainer", "top loser", "midcap loser",
    "index rejig", "hits 52-week", "target price", "upper circuit", "lower circuit",
)
PROSPECTIVE = ("eyes rs", "eyes ₹", "eyeing", "set to award", "plans to award", "market to reach", "opportunity worth", "pipeline worth", "expected to award")
PROGRAMMES = ("dac clears", "dac approves", "cabinet approves", "cabinet clears", "ccs approves", "ccs clears", "acquisition proposals", "procurement proposals", "capital acquisition", "outlay", "budget allocation", "allocates", "sanctions")
SHARED = ("joint venture", "consortium", "partnership with")
RESULTS = (
    "q1 results", "q2 results", "q3 results", "q4 results", "q1 revenue", "q2 revenue", "q3 revenue", "q4 revenue", "quarterly results", "annual report", "net profit", "profit after tax", "net loss",
    "revenue rises", "revenue reaches", "revenue grows", "earnings summary", "results:", "profit up", "profit rises", "profit surges", "profit falls", "profit jumps",
)
AGGREGATES = ("projects to draw", "combined investment", "cumulative investment", "total investment of", "guarantee", "guarantees")
PRICE_MOVE = (
    r"\b(?:jump|jumps|jumped|surge|surges|surged|rally|rallies|rallied|soar|soars|soared|zoom|zooms|zoomed|slip|slips|slipped|plunge|plunges|plunged|crash|crashes|crashed|tank|tanks|tanked|"
    r"gain|gains|gained|fall|falls|fell|rise|rises|rose|climb|climbs|climbed|drop|drops|dropped|declines?|declined)\b[^.;]{0,30}?\d+(?:\.\d+)?\s*%"
)
JOINT = r"\bjvs?\b"
COMPANY_LIST = r"^[^:]{0,80}?,[^:]{0,80}?:"
SIZED_TYPES = ("order_win", "agreement", "acquisition", "contract", "tie_up")
SIZED = (
    "order", "contract", "deal", "acquisition", "acquires", "acquire", "to sell", "divest", "stake sale", "sells stake", "buyout", "stake", "investment", "invest", "capex", "tender", "bid",
    "letter of intent", "purchase order", "supply agreement",
)
UNITS = {"crore": 1.0, "cr": 1.0, "crores": 1.0, "lakh": 0.01, "lakhs": 0.01, "lac": 0.01, "million": 0.1, "mn": 0.1, "billion": 100.0, "bn": 100.0, "trillion": 100000.0}
USD = 83.0
COUNTED = (
    r"[\s-]*(?:equity\s+|preference\s+|bonus\s+)?(?:shares?|units?|nos\.?|tonnes?|tons?|kg|mw|gw|kwh|litres?|liters?|sq\.?\s*ft|square\s+feet|employees?|customers?|subscribers?|users?|vehicles?|seats?|rooms?|barrels?)\b"
)
ENTRY_MOVES = (
    "enters", "entry into", "forays into", "foray into", "to manufacture", "to make", "eyes", "targets", "wins order", "bags order", "wins contract", "sets up", "setting up", "groundbreaking",
    "new facility", "new plant", "expands into", "expansion into", "begins production", "starts production", "ramps up",
)
CHALLENGER = r"\b([A-Z][A-Za-z0-9&]+(?:\s+[A-Z][A-Za-z0-9&]+){0,2})\s+(?:eyes|enters|targets|forays|sets|wins|bags|begins|starts|expands|ramps|plans)\b"
NO_COMPANIES = "india centre center government cabinet ministry minister sebi rbi nse bse pm cm state union budget china us usa".split()
SELLS = ("sells", "dumped", "exits", "offloads", "reduces stake")
BUYER = r"^([A-Z0-9][A-Za-z0-9\s\.&]+?)\s+(?:buys|acquires|sells|purchases|picks up|offloads|exits|increases|decreases|shares|block|bulk|mutual)"
DEAL = r"(?i)(\d+(?:\.\d+)?%\s*stake|\d+\s*(?:lakh|million|crore)?\s*shares|worth\s*(?:Rs\s*)?\d+\s*(?:cr|crore|crores)?)"
DEAL_COMPANY = r"(?:in|of|shares of|stake in|shares in)\s+([A-Z][A-Za-z0-9\s&]+?)(?:\s+via|\s+worth|\s+for|\s+at|\s+through|\s+block|\s+bulk|$)"
#: What headlines call a sector's business.
BATTLEGROUNDS = {
    "manufacturing_electronics": (
        "mobile manufacturing", "smartphone", "handset", "oppo", "vivo", "xiaomi", "laptop", "notebook", "ems", "electronics manufacturing", "pcb", "pcba", "led tv", "television", "contract manufacturing",
    ),
    "surveillance_security": ("cctv", "surveillance camera", "ip camera", "dvr", "anti-drone", "drone system"),
    "clean_energy": ("solar module", "solar cell", "wind turbine", "electrolyser", "electrolyzer", "green hydrogen", "battery storage"),
    "semiconductors_equipment": ("osat", "semiconductor fab", "chip packaging", "wafer", "silicon carbide"),
    "data_center_support": ("data center", "data centre", "optical fibre", "optical fiber"),
    "aerospace_defence": ("missile", "radar system", "defence electronics", "uav"),
    "textiles_apparel": ("garment manufacturing", "apparel manufacturing", "textile mill", "home textiles"),
    "sports_athleisure": ("footwear manufacturing", "athleisure"),
}



def any_of(phrases: tuple[str, ...]) -> str:
    """A pattern that matches where one of the phrases occurs."""
    return "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in phrases)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def cleaned(words: Column) -> Column:
    """Tokens in lower case, without full stops and a possessive at the end."""
    return F.transform(words, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"\.+$", ""), "'s$", ""))


def event(clause: Column) -> Column:
    """(type, phrase) of a clause, the first type in order that has a phrase in it; null for a denial."""
    low = F.lower(clause)
    found = F.coalesce(*[F.when(low.contains(p), F.struct(F.lit(kind).alias("type"), F.lit(p).alias("phrase"))) for kind, phrases in EVENTS.items() for p in phrases])
    return F.when(~low.rlike(any_of(NEGATIONS)), found)


def certainty(clause: Column) -> Column:
    low = F.lower(clause)
    return F.when(low.rlike(any_of(REPORTED)), "reported").when(low.rlike(any_of(ANNOUNCED)), "announced").otherwise("completed")


def attributable(title: Column) -> Column:
    """Whether an amount in the headline can belong to one company."""
    low = F.lower(title)
    told = [COMMENTARY, PROGRAMMES, PROSPECTIVE, SHARED, RESULTS, AGGREGATES]
    no = low.rlike("|".join(any_of(x) for x in told)) | low.rlike(PRICE_MOVE) | low.rlike(JOINT) | title.rlike(COMPANY_LIST)
    return ~no


def sized(kind: Column, title: Column) -> Column:
    return attributable(title) & (F.coalesce(F.lower(F.trim(kind)).isin(*SIZED_TYPES), F.lit(False)) | F.lower(title).rlike(any_of(SIZED)))


#: An amount with what decides on it: six characters before, a currency, the number, its unit, a second unit, a thing counted.
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
AMOUNT = rf"(?i)((?:rs\.?|inr|₹|usd|us\$|\$)\s*)?(\d[\d,]*(?:\.\d+)?)[\s-]*({_UNIT})(?:[\s-]*(crore|cr)\b)?"
_BEFORE = r"(?i)(?:usd|us\$|dollar|\$)"


def amount(text: Column) -> Column:
    """The largest amount of money in a text, in crores; null if there is none.

    Amounts follow one another without overlap, so the text is cut into pieces that end with an amount each.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?is).*?(?:{AMOUNT[4:]})"), F.lit(0))
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + F.char_length(x))))

    def one(piece: Column, i: Column) -> Column:
        last = rf"(?is)^.*?{AMOUNT[4:]}$"
        part = lambda k: F.lower(F.regexp_extract(piece, last, k))
        number = F.regexp_replace(part(2), ",", "").try_cast("double")
        unit, second, mark = part(3), part(4), part(1)
        single = F.coalesce(*[F.when(unit == u, v) for u, v in UNITS.items()])
        factor = F.when((second != "") & unit.isin("lakh", "lac") & ~((unit == "lac") & (second == "cr")), 100000.0).otherwise(single)
        rest = F.substring(text, F.element_at(ends, i + 2) + 1, F.lit(60))
        counts = (mark == "") & rest.rlike(f"(?i)^{COUNTED}")
        matched = F.char_length(F.regexp_extract(piece, rf"(?is)^.*?({AMOUNT[4:]})$", 1))
        # the six characters before the amount may lie in the piece before
        start = F.element_at(ends, i + 2) - matched
        window = F.substring(text, F.greatest(F.lit(1), start - 5), F.least(F.lit(6), start))
        foreign = mark.rlike(_BEFORE) | window.rlike(_BEFORE)
        return F.when(~counts, number * factor * F.when(foreign, USD).otherwise(1.0))

    return F.array_max(F.transform(pieces, one))


def band(percent: Column) -> Column:
    # fixed values: 2, 5 and 15 percent of a year's revenue
    return F.when(percent.isNull(), "unknown").when(percent >= 15, "transformative").when(percent >= 5, "material").when(percent >= 2, "minor").otherwise("immaterial")


def weight(kind: Column) -> Column:
    return F.when(kind == "transformative", 1.5).when(kind == "minor", 0.5).when(kind == "immaterial", 0.25).otherwise(1.0)


def challenger(title: Column) -> Column:
    """The capitalised name that makes an entry move; null if it is no company's."""
    name = F.regexp_extract(title, CHALLENGER, 1)
    public = F.exists(F.split(F.lower(name), r"\s+"), lambda w: w.isin(*NO_COMPANIES))
    return F.when((name != "") & ~public, name)


def block_deal(title: Column) -> Column:
    """buyer, action, company and details of a deal's headline, with plain words where it does not tell them."""
    part = lambda pattern, other: F.coalesce(F.nullif(F.trim(F.regexp_extract(title, pattern, 1)), F.lit("")), F.lit(other))
    action = F.when(F.lower(title).rlike(any_of(SELLS)), "Sell").otherwise("Buy")
    return F.struct(part(BUYER, "Institutional Investor").alias("buyer"), action.alias("action"), part(DEAL_COMPANY, "Listed Company").alias("company"), part(DEAL, "Block Deal").alias("details"))
