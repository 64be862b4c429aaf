"""What a dashboard is given of a run: feeds cut to their caps, warnings that call for a decision, and what is new.

Every list is cut where its rows lie: a task hands on no more rows of a list than it shows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.coerce import severity_rank
from marketlens.operators.sets import top_of
from marketlens.session import apart

# fixed values: how many rows of a feed are shown, and of a company's topics
FEED_CAPS = {"corporate_agreements": 40, "product_launches": 40, "corporate_filings": 40, "sebi_filings": 30, "institutional_activity": 40, "emerging_competitors": 30, "market_events": 40, "global_market_news": 20}
TOPICS = 5
CHANGED = ("new", "escalated")
# fixed values: groups of what is new with their tone and how many rows they show, in order
GROUPS = (("Analyst targets moved", "info", 6), ("Theses broken", "danger", 6), ("Watchlist changes", "success", 6), ("Deferred candidates", "info", 5), ("New entrants", "warning", 4), ("Critical alerts", "danger", 6))


def capped(feeds: DataFrame, caps: Mapping[str, int] = FEED_CAPS) -> DataFrame:
    """feeds (feed, place, ...) -> the first rows of each feed by place, with ``rank``; feeds without a cap stay whole, rank null."""
    listed = F.coalesce(F.col("feed").isin(*caps), F.lit(False))
    cap = F.coalesce(*[F.when(F.col("feed") == name, n) for name, n in caps.items()])
    # the widest cap first, as a constant is applied in each task before the shuffle
    cut = top_of(feeds.where(listed), ["feed"], [F.asc_nulls_last("place")], max(caps.values())).where(F.col("rank") <= cap)
    return cut.unionByName(feeds.where(~listed).withColumn("rank", F.lit(None).cast("int")))


def capped_topics(topics: DataFrame, k: int = TOPICS) -> DataFrame:
    """topics (ticker, place, ...) -> each company's first k."""
    return top_of(topics, ["ticker"], [F.asc_nulls_last("place")], k)


def actionable(warnings: DataFrame) -> DataFrame:
    """Warnings that are new or escalated; one without a status is a standing one."""
    return warnings.where(F.col("status").isin(*CHANGED))


def standing(warnings: DataFrame) -> DataFrame:
    """Ongoing warnings as one row for each category and severity: direction, n, tickers (each once), gravity (0 the gravest)."""
    rows = warnings.where("status = 'ongoing'").groupBy("category", "severity").agg(F.min("direction").alias("direction"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.nullif(F.col("ticker").cast("string"), F.lit("")))).alias("tickers"))
    known = F.col("severity").isin("Critical", "High", "Medium", "Low")
    return rows.withColumn("gravity", F.when(known, severity_rank(F.col("severity"))).otherwise(9))


def in_standing_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("gravity", F.desc("n"), "category", "severity")


def _figure(x: Column) -> Column:
    """Two digits at most, without zeros at the end."""
    return F.regexp_replace(x.cast("decimal(28,2)").cast("string"), r"\.?0+$", "")


def _said(rows: DataFrame, group: int, order: list[Column], text: Column) -> DataFrame:
    name, level, k = GROUPS[group]
    cut = top_of(rows.select("*", F.lit(name).alias("_group")), ["_group"], order, k, "_rank")
    return cut.select(F.lit(group).alias("seat"), F.lit(name).alias("group"), F.lit(level).alias("level"), F.col("_rank").alias("place"), text.alias("text"))


def whats_new(revisions: DataFrame, theses: DataFrame, ledger: DataFrame, candidates: DataFrame, entrants: DataFrame, warnings: DataFrame) -> DataFrame:
    """seat, group, level, place, text: what moved in this run. Groups without rows are left out, so a quiet run has none.

    revisions: (ticker, direction, target_change_pct), the largest first. theses: (ticker, place, health, reason).
    ledger: (ticker, place, action, price, date, outcome), in the order of place; rows without a ticker do not count, and
    if there are none the candidates that joined are told of. candidates: (place, ticker, name, status, action, replaced).
    entrants: (place, sector, challenger, incumbents). warnings: (ticker, category, severity, signal). Ties are ordered by
    ticker and name. Empty parts of a text are left out.
    """
    c, part = F.col, lambda x: F.nullif(x, F.lit(""))
    words = lambda *xs: F.concat_ws(" ", *[part(x) if isinstance(x, Column) else F.lit(x) for x in xs])
    moved = words(c("ticker"), "consensus target", F.when(c("direction") == "up", "raised").otherwise("cut"), F.concat(F.when(c("target_change_pct") > 0, "+").otherwise(""), _figure(c("target_change_pct")), F.lit("%")))
    done = F.replace(F.coalesce(part(c("action")), F.lit("changed")), F.lit("_"), F.lit(" "))
    outcome = F.concat(F.lit("— "), F.coalesce(part(c("outcome")), F.lit("not yet scored")))
    noted = ledger.where("ticker <> ''")
    none_noted = noted.limit(1).agg(F.count("*")).scalar() == 0
    joined = candidates.where("status = 'Watchlisted' and action is not null").where(none_noted)
    why = F.when(c("action") == "rotated_in", F.concat_ws(" ", F.lit("Rotated in for"), "replaced")).otherwise("Added")
    groups = [
        _said(revisions, 0, [F.desc_nulls_last(F.abs("target_change_pct")), c("ticker")], moved),
        _said(theses.where("health = 'Broken'"), 1, [F.asc_nulls_last("place"), c("ticker")], words(c("ticker"), "thesis broken", c("reason"))),
        _said(noted, 2, [F.asc_nulls_last("place"), c("ticker")], words(c("ticker"), done, F.concat(F.lit("at "), _figure(c("price"))), c("date").cast("string"), outcome)),
        _said(joined, 2, [F.asc_nulls_last("place"), c("ticker")], words(c("ticker"), why)),
        _said(candidates.where("status = 'Deferred'"), 3, [F.asc_nulls_last("place"), c("ticker"), c("name")], words(F.coalesce(part(c("ticker")), "name"), "held for a later run")),
        _said(entrants, 4, [F.asc_nulls_last("place"), c("sector"), c("challenger")], words(c("challenger"), "entering", c("sector"), "— pressures", F.array_join("incumbents", ", "))),
        _said(warnings.where("severity = 'Critical'"), 5, [c("ticker"), c("category")], words(c("ticker"), c("category"), c("signal"))),
    ]
    # a few rows each
    return reduce(DataFrame.unionByName, map(apart, groups))
