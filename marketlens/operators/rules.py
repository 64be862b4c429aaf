"""Rule operators over one row per company. All rules are tested in one scan; each row gives the warnings that hold."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.coerce import severity_rank
from marketlens.functions.extract import owner_earnings
from marketlens.operators.sets import capped_total, top_of


@dataclass(frozen=True)
class Rule:
    """A direction, and severities with their categories and conditions, the gravest first."""

    direction: str
    levels: tuple[tuple[str, str, str], ...]


_SLIDE = "coalesce(margin_1 < margin_2 and margin_2 < margin_3, false)"
# fixed values: thresholds and category names
RULES = (
    Rule("risk", (("Critical", "Promoter Exit", "promoter_change <= -2"), ("High", "Promoter Selling", "promoter_change <= -1"))),
    Rule("risk", (("Critical", "FII Outflow", "fii_change <= -3"), ("High", "FII Selling", "fii_change <= -1"))),
    Rule("risk", (("High", "Revenue Contraction", "qoq < 0"),)),
    Rule("risk", (("High", "Liquidity Stress", "current_ratio < 1"),)),
    Rule("risk", (("High", "High Leverage", "debt_equity > 1"), ("Medium", "Elevated Leverage", "debt_equity > 0.5"))),
    Rule("risk", (("Critical", "Margin Compression", f"opm_change <= -12 or (opm_change <= -6 and {_SLIDE})"), ("High", "Margin Compression", f"opm_change <= -6 or (opm_change <= -2 and {_SLIDE})"), ("Medium", "Margin Compression", "opm_change <= -2"))),
    Rule("risk", (("Medium", "Valuation Stretch", "size(alerts) > 0"),)),
    Rule("risk", (("Critical", "Price Breakdown", "day_change <= -8"), ("High", "Price Breakdown", "day_change <= -5"))),
    Rule("risk", (("Low", "Below Trend", "price_to_ma > 0 and price_to_ma < 1"),)),
    Rule("opportunity", (("High", "Institutional Accumulation", "fii_change > 0 and dii_change > 0"), ("Medium", "Institutional Buying", "fii_change > 0 or dii_change > 0"))),
    Rule("opportunity", (("Medium", "Momentum Breakout", "volume_surge >= 2 and day_change > 0"),)),
)
# fixed values: how sure a category is and where it comes from
RULE_BOOK = (
    ("Promoter Exit", "High", "Screener shareholding pattern"),
    ("Promoter Selling", "High", "Screener shareholding pattern"),
    ("FII Outflow", "High", "Screener shareholding pattern"),
    ("FII Selling", "High", "Screener shareholding pattern"),
    ("Revenue Contraction", "High", "Screener quarterly results"),
    ("Liquidity Stress", "High", "Screener balance sheet"),
    ("High Leverage", "High", "Screener balance sheet"),
    ("Elevated Leverage", "High", "Screener balance sheet"),
    ("Margin Compression", "High", "Screener quarterly results"),
    ("Valuation Stretch", "Medium", "Computed valuation screens"),
    ("Price Breakdown", "High", "Yahoo Finance quote"),
    ("Below Trend", "Medium", "Yahoo Finance quote"),
    ("Institutional Accumulation", "High", "Screener shareholding pattern"),
    ("Institutional Buying", "High", "Screener shareholding pattern"),
    ("Policy Catalyst", "Low", "Headline classification"),
    ("Momentum Breakout", "Medium", "Yahoo Finance quote"),
    ("Market Share", "Medium", "Computed industry share"),
    ("Corporate Move", "Low", "Headline classification"),
    ("Ecosystem Signal", "Low", "Headline classification via entity graph"),
    ("Supply Chain", "Low", "Headline classification"),
    ("Promoter Pledging", "High", "Screener shareholding pattern"),
    ("Input Cost Shock", "Medium", "Commodity/FX price series"),
    ("Supply Stress (Forward)", "Low", "Headline count over a rolling window"),
    ("Market Share Gain", "Medium", "Computed peer-group share"),
    ("Market Share Loss", "Medium", "Computed peer-group share"),
    ("Growth Laggard", "Medium", "Computed sector median"),
    ("Competitive Threat", "Low", "Headline classification"),
    ("New Entrant", "Low", "Headline classification"),
)
_UNKNOWN = ("Medium", "Mixed")


def _level(rule: Rule) -> Column:
    found = F.lit(None).cast("struct<severity:string,category:string>")
    for severity, category, condition in reversed(rule.levels):
        found = F.when(F.expr(condition), F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"))).otherwise(found)
    return F.struct(F.lit(rule.direction).alias("direction"), found.alias("found"))


def warnings(companies: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """ticker, sector, category, direction, severity. Companies without a column ``alerts`` fail no valuation screen."""
    if "alerts" not in companies.columns:
        companies = companies.withColumn("alerts", F.array().cast("array<string>"))
    tested = F.array(*[_level(r) for r in rules])
    rows = companies.select("ticker", "sector", F.explode(F.filter(tested, lambda x: x["found"].isNotNull())).alias("w"))
    return rows.select("ticker", "sector", "w.found.category", "w.direction", "w.found.severity")


def with_rules(found: DataFrame) -> DataFrame:
    """Warnings with confidence and evidence_source of their category."""
    book = found.sparkSession.createDataFrame(RULE_BOOK, "category string, confidence string, evidence_source string")
    joined = found.join(F.broadcast(book), "category", "left")
    return joined.withColumns({"confidence": F.coalesce("confidence", F.lit(_UNKNOWN[0])), "evidence_source": F.coalesce("evidence_source", F.lit(_UNKNOWN[1]))})


def in_order(found: DataFrame) -> DataFrame:
    """Risks first, the gravest first, then by ticker."""
    return found.orderBy(F.when(F.col("direction") == "risk", 0).when(F.col("direction") == "opportunity", 1).otherwise(9), severity_rank(F.col("severity")), "ticker")


def escalated(found: DataFrame, least: float = 5.0) -> DataFrame:
    """Opportunities whose order is ``least`` percent of a year's revenue or more (materiality_pct) rise by one severity."""
    up = F.when(F.col("severity") == "Low", "Medium").when(F.col("severity") == "Medium", "High").when(F.col("severity") == "High", "Critical").otherwise(F.col("severity"))
    return found.withColumn("severity", F.when((F.col("direction") == "opportunity") & (F.col("materiality_pct") >= least), up).otherwise(F.col("severity")))


def with_status(now: DataFrame, before: DataFrame) -> DataFrame:
    """new, escalated or ongoing against the run before (ticker, category, severity)."""
    before = before.select("ticker", "category", F.col("severity").alias("was"))
    rank, was = severity_rank(F.col("severity")), severity_rank(F.col("was"))
    return now.join(before, ["ticker", "category"], "left").withColumn("status", F.when(F.col("was").isNull(), "new").when(rank < was, "escalated").otherwise("ongoing")).drop("was")


def thesis_health(companies: DataFrame, found: DataFrame, revised: DataFrame) -> DataFrame:
    """Broken, Weakening or Intact by the company's risks; a target cut by ten percent or more makes it one step worse."""
    risk = found.where("direction = 'risk'").groupBy("ticker").agg(F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity") == "High").alias("high"), F.count_if(F.col("severity").isin("Medium", "Low")).alias("other"))
    cut = revised.select("ticker", ((F.col("direction") == "down") & (F.abs("target_change_pct") >= 10)).alias("cut"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = companies.select("ticker", "sector").join(risk, "ticker", "left").join(cut, "ticker", "left").select("ticker", "sector", none("critical"), none("high"), none("other"), F.coalesce("cut", F.lit(False)).alias("cut"))
    worse = F.when((F.col("critical") > 0) | (F.col("high") >= 2), 2).when((F.col("high") == 1) | (F.col("other") >= 2), 1).otherwise(0) + F.col("cut").cast("int")
    return joined.withColumn("health", F.when(worse == 0, "Intact").when(worse == 1, "Weakening").otherwise("Broken"))


def pledge_verdict(companies: DataFrame) -> DataFrame:
    """Status and severity of pledged shares. Unknown is a status of its own; rising and near the low make it graver."""
    pledged = F.col("pledged")
    rising = F.coalesce(F.col("pledged_change") >= 0.5, F.lit(False))
    near_low = F.coalesce(F.col("above_low").between(0, 20), F.lit(False))
    rows = companies.select("ticker", "pledged", rising.alias("rising"), near_low.alias("near_low"))
    # fixed values: 5, 15 and 40 percent, half a point, a fifth over the low
    status = F.when(pledged.isNull(), "not_disclosed").when(pledged <= 0, "none").when(pledged >= 40, "severe").when(pledged >= 15, "high").when((pledged >= 5) | F.col("rising"), "notable").otherwise("none")
    grave = (
        F.when(pledged.isNull() | (pledged <= 0), F.lit(None).cast("string")).when(pledged >= 40, "Critical")
        .when(pledged >= 15, F.when(F.col("rising") | F.col("near_low"), "Critical").otherwise("High"))
        .when(pledged >= 5, F.when(F.col("rising") & F.col("near_low"), "High").otherwise("Medium")).when(F.col("rising"), "Medium")
    )
    return rows.select("ticker", F.round("pledged", 2).alias("pledged_pct"), "rising", "near_low", status.alias("status"), grave.alias("severity"))


def graham(companies: DataFrame, bond_yield: float = 7.0) -> DataFrame:
    """Value from a year's earnings (eps): eps * (8.5 + 2g) * 4.4 / yield, and the upside to it.

    g is the growth over the trailing year (ttm) held between 0 and 15, or 6 if it is unknown. There is no value without
    earnings, or where the last quarter (q_eps, q_opm) shows a loss.
    """
    rate = F.when(F.col("ttm").isNull(), 6.0).otherwise(F.least(F.greatest(F.col("ttm"), F.lit(0.0)), F.lit(15.0)))
    intact = ~F.coalesce(F.col("q_eps") < 0, F.lit(False)) & ~F.coalesce(F.col("q_opm") < 0, F.lit(False))
    value = F.when((F.col("eps") > 0) & intact, F.round(F.col("eps") * ((8.5 + 2 * rate) * (4.4 / bond_yield)), 1)).otherwise(0.0)
    upside = F.when((F.col("price") > 0) & (F.col("graham_value") > 0), F.least(F.greatest((F.col("graham_value") - F.col("price")) / F.col("price") * 100, F.lit(-50.0)), F.lit(60.0)))
    return companies.withColumn("graham_value", value).withColumn("upside", upside)


def moat_points() -> Column:
    """How many of three hold: returns on capital and on equity over 15, debt under half of half the market's value.

    Unknown debt counts as none, an unknown market value as one.
    """
    holds = lambda c: F.when(c, 1).otherwise(0)
    value = F.when(F.col("value") != 0, F.col("value")).otherwise(1.0)
    return holds(F.col("roce") > 15) + holds(F.col("roe") > 15) + holds(F.coalesce("debt", F.lit(0.0)) / (0.5 * value) < 0.5)


def below_net_assets() -> Column:
    """Whether the price lies under the net current assets of a share."""
    return F.col("price") < F.col("net_assets") / F.when(F.col("price") > 0, F.col("value") / F.col("price")).otherwise(1.0)


def potential(companies: DataFrame) -> DataFrame:
    """The analysts' target where there are analysts, else the value from earnings, else none."""
    rated = graham(companies)
    told = (F.col("analysts") > 0) & (F.col("target") > 0) & (F.col("price") > 0)
    # fixed values: the methods' names
    method = F.when(told, "Analyst Consensus").when(F.col("upside").isNotNull(), "Fundamental Estimate").otherwise("No Estimate")
    return rated.select("ticker", "sector", method.alias("method"), F.when(told, (F.col("target") - F.col("price")) / F.col("price") * 100).otherwise(F.col("upside")).alias("potential"))


def valuation_alerts(companies: DataFrame) -> DataFrame:
    """ticker, alerts: the screens that a company fails, in a fixed order."""
    return valuation_alerts_of(graham(companies)).select("ticker", "alerts")


def valuation_alerts_of(valued: DataFrame) -> DataFrame:
    """graham()'s rows with alerts. Missing figures count as zero, but for ratios."""
    pe, zero = F.coalesce("pe", F.lit(0.0)), lambda c: F.coalesce(F.col(c), F.lit(0.0))
    slower = F.coalesce(F.col("revenue_last") < F.col("revenue_before"), F.lit(False)) | F.coalesce(F.col("qoq") < 15, F.lit(False))
    # fixed values: thresholds and messages
    tested = (
        (F.col("current_ratio") < 2, F.lit("Fails Current Ratio (< 2.0)")), (zero("debt") > zero("net_assets"), F.lit("Fails Debt Limit (Debt > Net Assets)")),
        ((pe > 15) & ~(F.col("price") <= F.col("graham_value") * 1.2), F.concat(F.lit("Fails P/E Screen (P/E "), pe.cast("string"), F.lit(" > 15 & Price > Intrinsic)"))),
        (zero("dividend") == 0, F.lit("No Dividend Yield")), ((pe > 30) & slower, F.lit("Hyper-Growth Reality Check (P/E > 30 & revenue growth decelerating)")),
    )
    return valued.withColumn("alerts", F.array_compact(F.array(*[F.when(c, text) for c, text in tested])))


def candidates(peers: DataFrame, k: int = 3) -> DataFrame:
    """The k fastest peers of each sector that are large, hold a share and grow: by profit if it is plausible, else by sales."""
    fine = lambda c: F.when(F.col(c).between(-95, 150), F.col(c))
    rated = peers.withColumn("growth_pct", F.round(F.coalesce(fine("profit_var"), fine("sales_var")), 1)).where("market_cap >= 1000 and share >= 1 and growth_pct >= 15")
    basis = F.when(F.round("profit_var", 1) == F.col("growth_pct"), "profit growth").otherwise("revenue growth")
    return top_of(rated.select("sector", "ticker", "growth_pct", basis.alias("basis")), ["sector"], [F.desc("growth_pct"), F.col("ticker")], k)


def variant_perception(valued: DataFrame, least: float = 15.0) -> DataFrame:
    """Companies with a consensus whose own value, plausible against the price, lies ``least`` percent or more from it."""
    rows = valued.where("analysts > 0 and target > 0 and price > 0 and graham_value <> 0 and graham_value / price between 0.33 and 3")
    rows = rows.withColumn("divergence_pct", F.round((F.col("graham_value") - F.col("target")) / F.col("target") * 100, 1)).where(F.abs("divergence_pct") >= least)
    return rows.select("ticker", "sector", "divergence_pct", F.when(F.col("divergence_pct") > 0, "more_bullish").otherwise("more_bearish").alias("direction"))


def revisions(now: DataFrame, before: DataFrame, least: float = 3.0) -> DataFrame:
    """Companies of both runs whose target moved by ``least`` percent or more."""
    before = before.select("ticker", F.col("target").alias("was"), F.col("analysts").alias("n"), F.col("rec").alias("r"))
    got = now.join(before, "ticker").where("was <> 0 and target is not null").withColumn("target_change_pct", F.round((F.col("target") - F.col("was")) / F.col("was") * 100, 2)).where(F.abs("target_change_pct") >= least)
    return got.select("ticker", "sector", "target_change_pct", (F.col("analysts") - F.col("n")).cast("int").alias("analyst_count_change"), F.round(F.col("rec") - F.col("r"), 2).alias("rec_score_change"), F.when(F.col("target") > F.col("was"), "up").otherwise("down").alias("direction"))


def scored_decisions(ledger: DataFrame, age: int = 45) -> DataFrame:
    """(date, today, price_at_decision, target_at_decision, price) -> with realized_return_pct and outcome."""
    move = lambda c: F.when(F.col("price_at_decision") != 0, F.round((F.col(c) - F.col("price_at_decision")) / F.col("price_at_decision") * 100, 1))
    ripe = F.date_diff("today", "date") >= age
    rows = ledger.withColumns({"realized": move("price"), "anticipated": move("target_at_decision")})
    won = (F.col("anticipated") > 0) & (F.col("realized") >= 0.5 * F.col("anticipated"))
    # fixed values: the outcomes' names
    outcome = F.when(~ripe, "pending").when(F.col("price").isNull(), "Left Watchlist (unscored)").when(won, "Thesis Playing Out").otherwise("Underperforming")
    return rows.withColumns({"realized_return_pct": F.when(ripe & F.col("price").isNotNull(), F.col("realized")), "outcome": outcome})


# fixed values: points of news by kind, their cap and greatest age, and what stands in where there are none
NEWS_CAP = 8
NEWS_DAYS = 120
FALLBACK_POINTS = 1
LEAST_NEWS_POINTS = 3


def news_gain(kind: Column, title: Column) -> Column:
    up = F.upper(F.coalesce(kind, F.lit("")))
    # fixed values: points of each kind
    return F.when(F.upper(title).contains("PLI") | (up == "PLI"), 5).when(up.contains("AGREEMENT") | up.contains("MOU"), 4).when(up.contains("LAUNCH"), 3).otherwise(4)


def news_points(events: DataFrame, today: Column) -> DataFrame:
    """events (ticker, place, title, type, day, weight) -> ticker, n_counted, momentum: points of news in order up to the cap.

    Headlines that read alike count once, the first; if that is too old, so are the later ones. An event without a day is
    not too old. weight is that of the amount against revenue. A quarter of three points is the least that an event gives,
    so no more than the first 11 of a ticker can count, and no more are brought together.
    """
    key = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9 ]+", "")
    one = events.withColumn("key", key).where("key <> ''").groupBy("ticker", "key").agg(F.min_by(F.struct("place", "title", "type", "day", "weight"), "place").alias("e")).select("ticker", "e.*")
    young = one.where(F.col("day").isNull() | (F.date_diff(today, "day") <= NEWS_DAYS)).withColumn("gain", news_gain(F.col("type"), F.col("title")) * F.col("weight").cast("double"))
    most = math.ceil(NEWS_CAP / (LEAST_NEWS_POINTS * 0.25))
    first = top_of(young, ["ticker"], [F.col("place")], most).drop("rank")
    return capped_total(first, ["ticker"], ["place"], "gain", NEWS_CAP).select("ticker", "n_counted", F.bround("total", 0).cast("int").alias("momentum"))


def liquidity_warning(label: str) -> Column:
    """What is told of a company that is hard to trade (advt_cr, days_to_exit_1cr); null if its turnover is unknown."""
    # fixed values: the text
    days = F.when(F.col("days_to_exit_1cr") != 0, F.format_string(", ~%d sessions to exit Rs 1 Cr", F.bround("days_to_exit_1cr", 0).cast("long")))
    return F.when(F.col("advt_cr").isNotNull(), F.concat(F.format_string(f"{label}: Rs %.2f Cr traded daily", "advt_cr"), F.coalesce(days, F.lit(""))))


def aggregate_score(companies: DataFrame) -> DataFrame:
    """Points for and against a company, what they advise, how sure that is, and the reasons and risks in order.

    companies: the columns of graham() and the rules, momentum (news_points(); null if there is no news) and
    liquidity_band, advt_cr, days_to_exit_1cr (null if unknown). A company of which nothing is known has the points of its news alone.
    """
    c = F.col
    text = lambda pattern, *of: F.format_string(pattern, *[c(x) if isinstance(x, str) else x for x in of])
    told = lambda before, column, after: F.concat(F.lit(before), c(column).cast("string"), F.lit(after))
    rows = valuation_alerts_of(graham(companies)).withColumns({"moat": moat_points(), "bargain": F.coalesce(below_net_assets(), F.lit(False))})
    rows = rows.withColumn("failed", F.filter("alerts", lambda x: x.rlike("Debt Limit|P/E Screen|Hyper-Growth|Current Ratio")))
    under = ~c("bargain") & (c("graham_value") != 0) & (c("price") != 0) & (c("price") < c("graham_value"))
    # fixed values: conditions, points, whether a reason or a risk, and texts
    tested = [
        (c("ttm") >= 15, 1, "+", text("Strong revenue growth (TTM %+.1f%%)", "ttm")), (c("ttm") < 0, -2, "-", text("Revenue shrinking (TTM %+.1f%%)", "ttm")),
        (c("opm_change") >= 2, 1, "+", told("Operating Margin Expansion (+", "opm_change", "%)")), (c("opm_change") <= -2, -1, "-", told("Operating margin contracted (", "opm_change", "pp)")),
        (c("debt_equity") < 0.5, 1, "+", told("Low Debt to Equity (", "debt_equity", ")")), (c("debt_equity") > 1, -2, "-", told("High Debt to Equity (", "debt_equity", ")")),
        (c("current_ratio") >= 2, 1, "+", told("Strong Liquidity (Current Ratio: ", "current_ratio", ")")), (c("current_ratio") < 1, -1, "-", F.lit("Poor Liquidity (Current Ratio < 1)")),
        (c("roce") >= 20, 1, "+", told("High Return on Capital (ROCE: ", "roce", "%)")), (c("roe") >= 15, 1, "+", told("High Return on Equity (ROE: ", "roe", "%)")),
        (c("liquidity_band") == "illiquid", -2, "-", liquidity_warning("Illiquid")), (c("liquidity_band") == "thin", -1, "-", liquidity_warning("Thin")),
        (c("liquidity_band") == "liquid", 0, "+", text("Liquid (Rs %d Cr traded daily)", F.bround("advt_cr", 0).cast("long"))),
        (c("promoter_change") <= -1, -2, "-", told("Promoters cut their stake (", "promoter_change", "%)")), (c("fii_change") > 0, 2, "+", told("FII Accumulation (+", "fii_change", "%)")), (c("fii_change") < -1, -1, "-", told("FII Selling (", "fii_change", "%)")),
        (c("dii_change") > 0, 1, "+", told("DII Accumulation (+", "dii_change", "%)")), (c("moat") == 3, 3, "+", F.lit("Wide Economic Moat (Sustained Margin Expansion)")), (c("moat") == 2, 1, "+", F.lit("Narrow Economic Moat")),
        (c("bargain"), 3, "+", F.lit("Deep Value Bargain (Price < NCAV)")), (under, 2, "+", told("Trading below Graham Intrinsic Value (", "graham_value", ")")),
    ]
    points = sum((F.when(cond, n).otherwise(0) for cond, n, _, _ in tested), -2 * F.size("failed"))
    some = lambda side: F.array_compact(F.array(*[F.when(cond, t) for cond, _, which, t in tested if which == side]))
    known = sum((c(x).isNotNull().cast("int") for x in ("revenue_last", "debt_equity", "ttm", "roce")), F.when(c("value").isNotNull(), 2).otherwise(0))
    momentum = F.coalesce(c("momentum"), F.lit(FALLBACK_POINTS)).cast("int")
    rows = rows.select("ticker", known.alias("known"), F.when(known > 0, points).otherwise(0).cast("int").alias("fundamental_score"), momentum.alias("momentum_score"), some("+").alias("reasons"), F.concat(some("-"), "failed").alias("risks"))
    rows = rows.withColumn("overall_score", (c("fundamental_score") + c("momentum_score")).cast("int"))
    advice = F.when(c("known") == 0, "Monitor (Data Unavailable)").when(c("overall_score") >= 15, "Strong Buy Candidate").when(c("overall_score") >= 10, "Buy Candidate").when(c("overall_score") >= 5, "Hold / Monitor").otherwise("Avoid / High Risk")
    sure = F.when(c("known") == 0, "Very Low").when(c("known") >= 5, "High").when(c("known") >= 3, "Medium").otherwise("Low")
    none = F.array().cast("array<string>")
    return rows.select(
        "ticker", "fundamental_score", "momentum_score", "overall_score", advice.alias("recommendation"), sure.alias("confidence"),
        F.when(c("known") > 0, c("reasons")).otherwise(none).alias("reasons"), F.when(c("known") > 0, c("risks")).otherwise(F.array(F.lit("No financial data available for scoring."))).alias("risks"),
    )


def margin_of_safety(companies: DataFrame) -> DataFrame:
    """Companies that pass the defensive screens, sell under their net assets, or have a pe between 0 and 15, with what they earn.

    companies: graham()'s columns, momentum and q_profit, capex.
    """
    rows = valuation_alerts_of(graham(companies))
    # fixed values: the screens that count, and the moats' names
    fails = F.exists("alerts", lambda x: x.rlike("Current Ratio|Debt Limit|P/E Screen|Dividend"))
    defensive = F.col("current_ratio").isNotNull() & F.col("pe").isNotNull() & ~fails
    points = moat_points()
    moat = F.when(points == 3, "Strong (Wide Moat)").when(points == 2, "Medium (Narrow Moat)").otherwise("Weak/None")
    cheap = F.coalesce((F.col("pe") > 0) & (F.col("pe") < 15), F.lit(False))
    found = rows.withColumns({"is_defensive_pass": defensive, "is_bargain": F.coalesce(below_net_assets(), F.lit(False)), "moat_status": moat, "owner_earnings": owner_earnings(F.col("q_profit"), F.col("debt"), F.col("capex"))})
    return found.where(F.col("is_defensive_pass") | F.col("is_bargain") | cheap).select("ticker", "graham_value", "is_bargain", "is_defensive_pass", "moat_status", "owner_earnings")
