"""Operators over ordered series: growth, shares, stages and trailing returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.coerce import growth, liquidity, move, verdict


def from_end(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds back (1 at the newest row) and n (rows of the key)."""
    by = Window.partitionBy(*keys)
    return rows.withColumns({"back": F.row_number().over(by.orderBy(F.desc(order))), "n": F.count("*").over(by)})


def holding_growth(series: DataFrame) -> DataFrame:
    """ticker, quarters, yoy, ttm, ttm_quality from (ticker, period, sales)."""
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("sales")))
    span = lambda a, b: F.sum(F.when(F.col("back").between(a, b), F.col("sales").cast("decimal(18,2)"))).cast("double")
    got = from_end(series, ["ticker"], "period").groupBy("ticker").agg(F.max("n").alias("quarters"), at(1).alias("s1"), at(5).alias("s5"), span(1, 4).alias("t1"), span(5, 8).alias("t2"))
    got = got.withColumns({"yoy": F.when(F.col("quarters") >= 5, growth("s1", "s5")), "ttm": F.when(F.col("quarters") >= 8, growth("t1", "t2"))})
    return got.withColumn("ttm_quality", verdict(F.col("ttm"), F.col("quarters"), 8, -95, 150)).select("ticker", "quarters", "yoy", "ttm", "ttm_quality")


def annual_cagr(series: DataFrame) -> DataFrame:
    """Compound growth over four years or more."""
    got = series.groupBy("ticker").agg(F.count("*").alias("years"), F.min_by("sales", "period").alias("first"), F.max_by("sales", "period").alias("last"))
    rate = F.when((F.col("years") >= 4) & (F.col("first") > 0) & (F.col("last") > 0), (F.pow(F.col("last") / F.col("first"), 1.0 / (F.col("years") - 1)) - 1) * 100)
    return got.select("ticker", "years", rate.alias("cagr"))


def sector_growth(growths: DataFrame) -> DataFrame:
    """Median growth of each sector's trustworthy holdings, the fastest of them, and how many were left out."""
    fine = F.col("ttm_quality") == "ok"
    value = F.when(fine, F.col("ttm"))
    return growths.groupBy("sector").agg(
        F.count_if(fine).alias("holdings"), F.count_if(~fine).alias("excluded"), F.percentile(value, 0.5).alias("median_ttm"), F.percentile(F.when(fine, F.col("yoy")), 0.5).alias("median_yoy"),
        F.max_by("ticker", F.when(fine, F.struct(F.col("ttm"), -F.col("ticker")))).alias("fastest"),
    ).withColumn("low_confidence", F.col("holdings") < 2)


def market_share(series: DataFrame, most: int = 4) -> DataFrame:
    """ticker's share of its sector's sales in the newest period and some periods before, in percent.

    Only series of two periods or more, all above zero, in sectors with two such. A sector looks back ``most`` periods,
    or as far as its shortest series goes.
    """
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("sales"))).alias(f"v{k}")
    newest = from_end(series, ["sector", "ticker"], "period")
    each = newest.groupBy("sector", "ticker").agg(F.max("n").alias("n"), F.min("sales").alias("least"), F.count("sales").alias("told"), *[at(k) for k in range(1, most + 2)]).where("n >= 2 and told = n and least > 0")
    sector = Window.partitionBy("sector")
    each = each.withColumns({"lookback_quarters": F.least(F.lit(most).cast("long"), F.min("n").over(sector) - 1), "peer_count": F.count("*").over(sector)}).where("peer_count >= 2")
    each = each.select("sector", "ticker", "lookback_quarters", "peer_count", F.col("v1").alias("now"), F.coalesce(*[F.when(F.col("lookback_quarters") == k, F.col(f"v{k + 1}")) for k in range(1, most + 1)]).alias("before"))
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).over(sector).cast("double")
    shares = each.withColumns({"share": F.col("now") / total("now") * 100, "share_before": F.col("before") / total("before") * 100})
    return shares.select("sector", "ticker", "share", "share_before", (F.col("share") - F.col("share_before")).alias("change"), "lookback_quarters", "peer_count")


def curve_stage(series: DataFrame) -> DataFrame:
    """The stage of growth of each sector of two series or more: median of the newest growth and of its change."""
    before = F.lag("sales").over(Window.partitionBy("ticker").orderBy("period"))
    steps = series.withColumn("before", before).where("before > 0").withColumn("step", (F.col("sales") - F.col("before")) / F.col("before") * 100)
    newest = from_end(steps, ["ticker"], "period").where("back <= 2").groupBy("sector", "ticker").agg(F.max(F.when(F.col("back") == 1, F.col("step"))).alias("last"), F.max(F.when(F.col("back") == 2, F.col("step"))).alias("prior"))
    got = newest.groupBy("sector").agg(F.count("*").alias("stock_count"), F.percentile("last", 0.5).alias("speed"), F.coalesce(F.percentile(F.col("last") - F.col("prior"), 0.5), F.lit(0.0)).alias("pull")).where("stock_count >= 2")
    # fixed values: limits and names of the stages
    stage = F.when((F.col("speed") >= 15) & (F.col("pull") >= 0), "Inflection / Steep Adoption").when(F.col("speed") >= 15, "Maturing").when((F.col("speed") >= 0) & (F.col("pull") > 2), "Pre-Inflection (building)").when(F.col("speed") < 0, "Late-Cycle / Contracting").otherwise("Steady State")
    return got.select("sector", "stock_count", F.round("speed", 1).alias("median_qoq_growth_pct"), F.round("pull", 1).alias("acceleration_pp"), stage.alias("stage"))


def sector_valuation(companies: DataFrame, cap: float = 200) -> DataFrame:
    """(ticker, sector, pe) with a positive pe: the sector's median, its cheapest and dearest, and the standing to it.

    A pe over ``cap`` is kept out of the sector's figures, unless all are.
    """
    priced = companies.where("pe > 0")
    sector = Window.partitionBy("sector")
    priced = priced.withColumn("used", (F.col("pe") <= cap) | ~F.bool_or(F.col("pe") <= cap).over(sector))
    key = lambda *c: F.when(F.col("used"), F.struct(*c))
    by = priced.groupBy("sector").agg(F.round(F.percentile(F.when(F.col("used"), F.col("pe")), 0.5), 1).alias("industry_pe"), F.count("pe").alias("priced"), F.min_by("ticker", key("pe", "ticker")).alias("cheapest"), F.max_by("ticker", key(F.col("pe"), -F.col("ticker"))).alias("priciest"))
    away = (F.col("pe") - F.col("industry_pe")) / F.col("industry_pe")
    percent = F.round(F.abs(away) * 100, 0).cast("int").cast("string")
    # fixed values: the band and the labels
    label = F.when(F.col("pe") > cap, "Extreme outlier (excluded from peer stats)").when(F.col("industry_pe") <= 0, "\u2014").when(away <= -0.1, F.concat(percent, F.lit("% below peers"))).when(away >= 0.1, F.concat(percent, F.lit("% above peers"))).otherwise("In line with peers")
    return priced.join(by, "sector").select("ticker", "sector", "industry_pe", "priced", "cheapest", "priciest", label.alias("pe_vs_peers"))


def traded_value(sessions: DataFrame, key: str) -> DataFrame:
    """(key, close, volume) -> mean traded value a day in crores of 1e7, its band, and days to sell 1 and 5 crores at a fifth of it."""
    fine = (F.col("close") > 0) & (F.col("volume") > 0) & ~F.isnan("close") & ~F.isnan("volume")
    got = sessions.groupBy(key).agg(F.count_if(F.col("close") != 0).alias("sessions"), (F.avg(F.when(fine, F.col("close") * F.col("volume"))) / 1e7).alias("value"))
    days = lambda x: F.when(F.col("value") > 0, F.round(x / (F.col("value") * 0.2), 1))
    return got.select(key, "sessions", F.round("value", 2).alias("advt_cr"), liquidity(F.col("value")).alias("liquidity_band"), days(1.0).alias("days_to_exit_1cr"), days(5.0).alias("days_to_exit_5cr"))


def price_range(closes: DataFrame, key: str, place: str) -> DataFrame:
    """Lowest and highest close of each key, and how far the last one (by ``place``) is over the lowest, in percent."""
    got = closes.where("close is not null and not isnan(close)").groupBy(key).agg(F.min("close").alias("low"), F.max("close").alias("high"), F.max_by("close", place).alias("last")).where("low > 0")
    price = lambda c: F.round(F.col(c).cast("decimal(18,6)"), 2).cast("double")
    return got.select(key, price("low").alias("week52_low"), price("high").alias("week52_high"), F.round((F.col("last") - F.col("low")) / F.col("low") * 100, 2).alias("pct_above_low"))


def trailing_returns(nav: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Returns of the newest value of each scheme against the value so many observations before."""
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("nav")))
    got = from_end(nav, ["scheme"], "day").where(F.col("back").isin(1, *[k + 1 for k in windows.values()]))
    return got.groupBy("scheme").agg(F.max("n").alias("days"), *[((at(1) - at(k + 1)) / at(k + 1) * 100).alias(name) for name, k in windows.items()])


def accumulation(returns: DataFrame, short: str, long: str) -> DataFrame:
    """Whether four times the short return runs above or below the long one."""
    year = F.col(short) * 4
    return returns.withColumn("trend", F.when(F.col(short).isNull() | F.col(long).isNull(), "unknown").when(year > F.col(long) * 1.15, "accelerating").when(year < F.col(long) * 0.85, "decelerating").otherwise("steady"))


def industry_share(peers: DataFrame, held: DataFrame) -> DataFrame:
    """peers (ticker, industry, sales), held (ticker, sector, industry) -> the held companies' shares of industries of two or more."""
    industry = Window.partitionBy("industry")
    total = F.sum(F.col("sales").cast("decimal(18,2)")).over(industry).cast("double")
    shares = peers.where("sales > 0").withColumns({"share_pct": F.round(F.col("sales") / total * 100, 2), "peer_count": F.count("*").over(industry)}).where("peer_count >= 2")
    return held.join(shares.select("ticker", "industry", "share_pct", "peer_count"), ["ticker", "industry"]).drop("industry")


def input_cost_shock(moves: DataFrame, exposure: DataFrame) -> DataFrame:
    """moves (input, pct), exposure (input, sector, weight, side) -> each sector's weighted pressure, its band and main driver.

    Quiet inputs and those without a price count for nothing; what a consumer pays is a producer's gain.
    """
    loud = moves.where(F.abs("pct") >= 5).join(F.broadcast(exposure), "input")
    pressure = F.when(F.col("side") == "consumer", F.col("pct")).otherwise(-F.col("pct")) * F.col("weight")
    got = loud.groupBy("sector").agg(F.round(F.sum(pressure.cast("decimal(28,10)")), 2).cast("double").alias("score"), F.count("*").alias("n_drivers"), F.max_by("input", F.struct(F.abs(F.col("pct") * F.col("weight")), F.col("input"))).alias("top_driver"))
    return got.withColumns({"band": move(F.col("score")), "direction": F.when(F.col("score") > 0, "cost pressure").otherwise("tailwind")})
