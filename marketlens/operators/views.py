"""What a briefing shows: orders, reasons, searches, themes and calendars, over results of the other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.sets import top_of

# fixed values: keywords, plan words and holidays
THEMES = (
    ("Manufacturing & PLI", ("manufacturing", "make in india")),
    ("Semiconductors & Tech", ("semiconductor", "technology", "digital")),
    ("Defence & Aerospace", ("defence", "defense", "aerospace")),
    ("Logistics & Infra", ("logistics", "transport", "infrastructure")),
)
PLAN_WORDS = ("direct", "regular", "growth", "idcw", "dividend", "payout", "reinvestment", "bonus", "quarterly", "monthly", "annual", "plan", "option")
HOLIDAYS = ("2026-01-26", "2026-03-03", "2026-03-26", "2026-03-31", "2026-04-03", "2026-04-14", "2026-05-01", "2026-05-28", "2026-06-26", "2026-08-15", "2026-09-14", "2026-10-02", "2026-11-08", "2026-12-25")


def theme(name: Column) -> Column:
    """The first theme with a keyword in the name; null for none."""
    low = F.lower(name)
    return F.coalesce(*[F.when(reduce(lambda x, y: x | y, [low.contains(w) for w in words]), title) for title, words in THEMES])


def base_name(name: Column) -> Column:
    """A fund's name up to the first word that tells of a plan or an option; hyphens are spaces."""
    words = F.filter(F.split(F.trim(F.replace(F.lower(name), F.lit("-"), F.lit(" "))), r"\s+"), lambda w: w != "")
    stop = F.array_position(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,()]+|[.,()]+$", "").isin(*PLAN_WORDS)), True)
    return F.array_join(F.when(stop > 0, F.slice(words, F.lit(1), (stop - 1).cast("int"))).otherwise(words), " ")


def thematic_schemes(schemes: DataFrame, k: int = 2) -> DataFrame:
    """(code, name, place) -> theme, code, rank: the first k funds of each theme, each fund's share classes once."""
    rows = schemes.withColumns({"theme": theme(F.col("name")), "base": base_name(F.col("name"))}).where("theme is not null and code is not null")
    first = rows.groupBy("theme", "base").agg(F.min(F.struct("place", "code")).alias("f")).select("theme", "base", "f.place", "f.code")
    return top_of(first, ["theme"], [F.col("place")], k).select("theme", "base", "code", "rank")


def is_trading_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~F.date_format(day, "yyyy-MM-dd").isin(*HOLIDAYS)


def suppression_reason(eps: Column, q_opm: Column, q_eps: Column, quarters: Column) -> Column:
    """Why a company has no value of its own; the first reason that holds."""
    text = lambda head, value, tail: F.concat(F.lit(head), value.cast("string"), F.lit(tail))
    return (
        F.when(eps <= 0, text("Negative trailing earnings (TTM EPS ", eps, ")")).when(q_opm < 0, text("Operating loss in the latest quarter (OPM ", q_opm, "%)"))
        .when(q_eps < 0, text("Latest quarter swung to a loss (EPS ", q_eps, ")")).when(F.coalesce(quarters, F.lit(0)) < 4, "Insufficient quarterly history for a trailing year")
        .otherwise("Insufficient data for an honest estimate")
    )


def input_cost_warnings(shocks: DataFrame) -> DataFrame:
    """A warning for each sector whose weighted input costs moved; without a ticker."""
    loud = shocks.where("band <> 'quiet' and band <> 'unmeasured'")
    return loud.select(
        F.lit("").alias("ticker"), "sector", F.when(F.col("band") == "severe", "High").otherwise("Medium").alias("severity"), F.when(F.col("score") > 0, "risk").otherwise("opportunity").alias("direction"), F.lit("Input Cost Shock").alias("category"),
    ).orderBy(F.col("severity") != "High", "sector")


def in_thesis_order(health: DataFrame) -> DataFrame:
    return health.orderBy(F.when(F.col("health") == "Broken", 0).when(F.col("health") == "Weakening", 1).otherwise(2), "ticker")


def found_in(rows: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows with the words, in whatever case, in one of the columns; all of them for no words."""
    if not words:
        return rows
    return rows.where(reduce(lambda x, y: x | y, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(words.lower()) for c in columns]))


def rating_score(rating: Column) -> Column:
    return F.when(rating == "Strong Buy", 4).when(rating == "Buy", 3).when(rating == "Hold", 2).when(rating.isin("Underperform", "Sell"), 1).otherwise(0)


def policy_catalysts(companies: DataFrame, events: DataFrame) -> DataFrame:
    """(ticker, name) and (company, kind, title) -> one warning a company, with its events' distinct labels.

    An event names a company or its ticker: two joins on equal keys, not one on either.
    """
    labelled = events.select(F.upper("company").alias("key"), F.concat_ws(": ", "kind", "title").alias("label"))
    by = [companies.select("ticker", F.upper(c).alias("key")) for c in ("name", "ticker")]
    both = by[0].join(labelled, "key").unionByName(by[1].join(labelled, "key")).select("ticker", "label").distinct()
    return both.groupBy("ticker").agg(F.count("*").alias("n_events"), F.min("label").alias("first_label")).select("ticker", F.lit("Medium").alias("severity"), F.lit("opportunity").alias("direction"), F.lit("Policy Catalyst").alias("category"), "n_events", "first_label")


def by_alias(warnings: DataFrame, sectors: DataFrame) -> DataFrame:
    """warnings (sector, ...) joined to sectors (key, label, name) under whichever of these they use, in any case."""
    names = sectors.select("key", F.explode(F.array_distinct(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("key", "label", "name")]))).alias("alias")).where("alias <> ''")
    return warnings.withColumn("alias", F.lower("sector")).join(F.broadcast(names), "alias").drop("alias")


def extremes(medians: DataFrame, value: str, key: str, k: int = 3) -> DataFrame:
    """The k lowest and the k highest of a table, as side and rank."""
    side = lambda name, order: medians.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.lit(name).alias("side"), "rank", key, value)
    return side("lowest", [F.asc(value), F.col(key)]).unionByName(side("highest", [F.desc(value), F.col(key)]))
