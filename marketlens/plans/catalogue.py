"""The registered market queries, each beside the SQL that gives the same rows.

A query takes (spark, folder) and returns a DataFrame over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import coerce
from marketlens.operators import rules, series, sets
from marketlens.session import with_checkpoints
from marketlens.sources.tables import holdings, metrics, money, sales_series, table
from marketlens.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOLDINGS = "SELECT s_suppkey AS ticker, s_name AS name, n_name AS sector, r_name AS region, s_acctbal AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
SERIES = "SELECT l_suppkey AS ticker, date_trunc('{}', l_shipdate) AS period, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sales FROM lineitem GROUP BY 1, 2"
QUARTERS = SERIES.format("quarter")
_WHOLE = "promoter_change:7,11,5,2 fii_change:5,13,8,2 dii_change:3,9,4,2 qoq:11,31,12,1 current_ratio:13,17,0,8 debt_equity:17,23,0,16 opm_change:19,29,16,1 day_change:23,19,11,1 volume_surge:29,37,0,16 price_to_ma:31,21,0,16 pe:37,41,0,1 pledged:41,43,0,2 pledged_change:43,7,3,2 above_low:47,53,0,1 eps:53,61,10,4 growth:59,67,20,1 roce:61,71,0,2 roe:67,73,0,2 analysts:71,79,0,1 price:73,83,0,1 target:79,89,0,1 pe_wide:131,307,0,1 debt:83,97,0,1 net_assets:89,101,0,1 dividend:97,5,0,2 q_eps:101,23,3,1 q_opm:103,29,4,1 rec:107,9,0,2 sales_var:127,211,50,1 profit_var:109,221,60,1 share:113,41,0,8 revenue_last:137,53,10,1 revenue_before:139,53,10,1 margin_1:149,31,0,1 margin_2:151,31,0,1 margin_3:157,31,0,1"
# figures that some companies lack: (divisor, remainder) of their tickers
_NULLS = {"pledged": (13, 5), "above_low": (11, 3), "current_ratio": (17, 2), "profit_var": (7, 3), "rec": (19, 4), "qoq": (23, 7)}
METRICS = f"SELECT *, {', '.join('CAST(((ticker * {}) % {} - {}) AS DOUBLE) / {}.0 AS '.format(*x.split(':')[1].split(',')) + x.split(':')[0] for x in _WHOLE.split())} FROM ({HOLDINGS})"
METRICS = f"SELECT * REPLACE ({', '.join(f'CASE WHEN ticker % {a} = {b} THEN NULL ELSE {c} END AS {c}' for c, (a, b) in _NULLS.items())}) FROM ({METRICS})"
_GROWTH = f"""
q AS ({QUARTERS}), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS back, count(*) OVER (PARTITION BY ticker) AS n FROM q),
g0 AS (SELECT ticker, max(n) AS quarters, max(sales) FILTER (WHERE back = 1) AS s1, max(sales) FILTER (WHERE back = 5) AS s5,
  CAST(sum(CAST(sales AS DECIMAL(18,2))) FILTER (WHERE back BETWEEN 1 AND 4) AS DOUBLE) AS t1, CAST(sum(CAST(sales AS DECIMAL(18,2))) FILTER (WHERE back BETWEEN 5 AND 8) AS DOUBLE) AS t2 FROM r GROUP BY ticker),
g1 AS (SELECT ticker, quarters, CASE WHEN quarters >= 5 AND s1 > 0 AND s5 > 0 THEN (s1 - s5) / s5 * 100 END AS yoy, CASE WHEN quarters >= 8 AND t1 > 0 AND t2 > 0 THEN (t1 - t2) / t2 * 100 END AS ttm FROM g0),
g AS (SELECT *, CASE WHEN quarters < 8 OR ttm IS NULL THEN 'insufficient' WHEN ttm NOT BETWEEN -95 AND 150 THEN 'out_of_band' ELSE 'ok' END AS ttm_quality FROM g1)"""
# written out rule by rule, not made from the operator's table
_WARN = """SELECT ticker, sector, category, direction, severity FROM (
  SELECT ticker, sector, CASE WHEN promoter_change <= -2 THEN 'Promoter Exit' ELSE 'Promoter Selling' END AS category, 'risk' AS direction, CASE WHEN promoter_change <= -2 THEN 'Critical' ELSE 'High' END AS severity FROM m WHERE promoter_change <= -1
  UNION ALL SELECT ticker, sector, CASE WHEN fii_change <= -3 THEN 'FII Outflow' ELSE 'FII Selling' END, 'risk', CASE WHEN fii_change <= -3 THEN 'Critical' ELSE 'High' END FROM m WHERE fii_change <= -1
  UNION ALL SELECT ticker, sector, 'Revenue Contraction', 'risk', 'High' FROM m WHERE qoq < 0
  UNION ALL SELECT ticker, sector, 'Liquidity Stress', 'risk', 'High' FROM m WHERE current_ratio < 1
  UNION ALL SELECT ticker, sector, CASE WHEN debt_equity > 1 THEN 'High Leverage' ELSE 'Elevated Leverage' END, 'risk', CASE WHEN debt_equity > 1 THEN 'High' ELSE 'Medium' END FROM m WHERE debt_equity > 0.5
  UNION ALL SELECT ticker, sector, 'Margin Compression', 'risk', ['Medium', 'High', 'Critical'][least(3, CASE WHEN opm_change <= -12 THEN 3 WHEN opm_change <= -6 THEN 2 ELSE 1 END + CASE WHEN margin_1 < margin_2 AND margin_2 < margin_3 THEN 1 ELSE 0 END)] FROM m WHERE opm_change <= -2
  UNION ALL SELECT ticker, sector, 'Price Breakdown', 'risk', CASE WHEN day_change <= -8 THEN 'Critical' ELSE 'High' END FROM m WHERE day_change <= -5
  UNION ALL SELECT ticker, sector, 'Below Trend', 'risk', 'Low' FROM m WHERE price_to_ma > 0 AND price_to_ma < 1
  UNION ALL SELECT ticker, sector, CASE WHEN fii_change > 0 AND dii_change > 0 THEN 'Institutional Accumulation' ELSE 'Institutional Buying' END, 'opportunity', CASE WHEN fii_change > 0 AND dii_change > 0 THEN 'High' ELSE 'Medium' END FROM m WHERE fii_change > 0 OR dii_change > 0
  UNION ALL SELECT ticker, sector, 'Momentum Breakout', 'opportunity', 'Medium' FROM m WHERE volume_surge >= 2 AND day_change > 0)"""
_RANK = "CASE {} WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def _valued(spark: SparkSession, d: str) -> DataFrame:
    """The companies' figures with ttm, their growth over the trailing year."""
    return metrics(spark, d).join(series.holding_growth(sales_series(spark, d)).select("ticker", "ttm"), "ticker", "left")


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 4) for c in columns})


def _sector_series(spark: SparkSession, d: str) -> DataFrame:
    return sales_series(spark, d).join(holdings(spark, d).select("ticker", "sector"), "ticker")


def _sector_growths(spark: SparkSession, d: str) -> DataFrame:
    return series.holding_growth(sales_series(spark, d)).join(holdings(spark, d).select("ticker", "sector"), "ticker")


@query(f"""WITH {_GROWTH}, h AS ({HOLDINGS}), x AS (SELECT g.*, h.sector FROM g JOIN h USING (ticker))
SELECT sector, count(*) FILTER (WHERE ttm_quality = 'ok') AS holdings, count(*) FILTER (WHERE ttm_quality <> 'ok') AS excluded, round(median(ttm) FILTER (WHERE ttm_quality = 'ok'), 4) AS median_ttm,
  round(median(yoy) FILTER (WHERE ttm_quality = 'ok'), 4) AS median_yoy, arg_max(ticker, (ttm, -ticker)) FILTER (WHERE ttm_quality = 'ok') AS fastest, count(*) FILTER (WHERE ttm_quality = 'ok') < 2 AS low_confidence FROM x GROUP BY sector""")
def ttm_growth_by_sector(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.sector_growth(_sector_growths(spark, d)), "median_ttm", "median_yoy").orderBy(F.desc("median_ttm"), "sector")


@query(f"WITH {_GROWTH} SELECT ticker, quarters, round(yoy, 4) AS yoy, round(ttm, 4) AS ttm, ttm_quality FROM g")
def holding_growth(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.holding_growth(sales_series(spark, d)), "yoy", "ttm")


@query(f"""WITH y AS ({SERIES.format("year")}), a AS (SELECT ticker, count(*) AS years, arg_min(sales, period) AS f, arg_max(sales, period) AS l FROM y GROUP BY 1)
SELECT ticker, years, CASE WHEN years >= 4 AND f > 0 AND l > 0 THEN round((pow(l / f, 1.0 / (years - 1)) - 1) * 100, 4) END AS cagr FROM a""")
def cagr_annual(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.annual_cagr(sales_series(spark, d, "year")), "cagr")


_PE = "CASE WHEN pe > 0 THEN pe END"


@query(f"""WITH m AS ({METRICS}), p AS (SELECT ticker, sector, pe_wide AS pe, pe_wide <= 200 AS fine FROM m WHERE pe_wide > 0), a AS (SELECT *, fine OR NOT bool_or(fine) OVER (PARTITION BY sector) AS used FROM p),
s AS (SELECT sector, round(median(pe) FILTER (WHERE used), 1) AS industry_pe, count(*) AS priced, arg_min(ticker, (pe, ticker)) FILTER (WHERE used) AS cheapest, arg_max(ticker, (pe, -ticker)) FILTER (WHERE used) AS priciest FROM a GROUP BY sector)
SELECT ticker, p.sector, industry_pe, priced, cheapest, priciest, CASE WHEN pe > 200 THEN 'Extreme outlier (excluded from peer stats)' WHEN industry_pe <= 0 THEN '—' WHEN (pe - industry_pe) / industry_pe <= -0.1 THEN CAST(CAST(round(abs((pe - industry_pe) / industry_pe) * 100, 0) AS INT) AS VARCHAR) || '% below peers'
  WHEN (pe - industry_pe) / industry_pe >= 0.1 THEN CAST(CAST(round((pe - industry_pe) / industry_pe * 100, 0) AS INT) AS VARCHAR) || '% above peers' ELSE 'In line with peers' END AS pe_vs_peers FROM p JOIN s ON p.sector = s.sector""")
def sector_valuation(spark: SparkSession, d: str) -> DataFrame:
    return series.sector_valuation(metrics(spark, d).select("ticker", "sector", F.col("pe_wide").alias("pe")))


@query(f"""WITH q AS ({QUARTERS}), h AS ({HOLDINGS}), x AS (SELECT q.*, sector, lag(sales) OVER (PARTITION BY ticker ORDER BY period) AS b FROM q JOIN h USING (ticker)),
s AS (SELECT *, (sales - b) / b * 100 AS step, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS back FROM x WHERE b > 0),
t AS (SELECT sector, ticker, max(step) FILTER (WHERE back = 1) AS last, max(step) FILTER (WHERE back = 2) AS prior FROM s WHERE back <= 2 GROUP BY 1, 2),
c AS (SELECT sector, count(*) AS stock_count, median(last) AS speed, coalesce(median(last - prior), 0) AS pull FROM t GROUP BY 1)
SELECT sector, stock_count, round(speed, 1) AS median_qoq_growth_pct, round(pull, 1) AS acceleration_pp, CASE WHEN speed >= 15 AND pull >= 0 THEN 'Inflection / Steep Adoption' WHEN speed >= 15 THEN 'Maturing'
  WHEN speed >= 0 AND pull > 2 THEN 'Pre-Inflection (building)' WHEN speed < 0 THEN 'Late-Cycle / Contracting' ELSE 'Steady State' END AS stage FROM c WHERE stock_count >= 2""")
def curve_stage(spark: SparkSession, d: str) -> DataFrame:
    return series.curve_stage(_sector_series(spark, d))


_SHARE = f"""q AS ({QUARTERS}), h AS ({HOLDINGS}), r AS (SELECT q.*, sector, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS back, count(*) OVER (PARTITION BY ticker) AS n, min(sales) OVER (PARTITION BY ticker) AS least FROM q JOIN h USING (ticker)),
k AS (SELECT *, least(4, min(n) OVER (PARTITION BY sector) - 1) AS lookback FROM r WHERE n >= 2 AND least > 0),
e AS (SELECT sector, ticker, max(lookback) AS lookback, max(sales) FILTER (WHERE back = 1) AS now, max(sales) FILTER (WHERE back = lookback + 1) AS before FROM k GROUP BY 1, 2),
t AS (SELECT *, now / CAST(sum(CAST(now AS DECIMAL(18,2))) OVER (PARTITION BY sector) AS DOUBLE) * 100 AS share, before / CAST(sum(CAST(before AS DECIMAL(18,2))) OVER (PARTITION BY sector) AS DOUBLE) * 100 AS share_before, count(*) OVER (PARTITION BY sector) AS peer_count FROM e QUALIFY peer_count >= 2)"""


@query(f"WITH {_SHARE} SELECT sector, ticker, round(share, 1) AS share_pct, round(share_before, 1) AS share_prev_pct, round(share - share_before, 2) AS change_pp, lookback AS lookback_quarters, peer_count FROM t")
def peer_market_share(spark: SparkSession, d: str) -> DataFrame:
    got = series.market_share(_sector_series(spark, d))
    return got.select("sector", "ticker", F.round("share", 1).alias("share_pct"), F.round("share_before", 1).alias("share_prev_pct"), F.round("change", 2).alias("change_pp"), "lookback_quarters", "peer_count")


@query(f"""WITH {_SHARE}, c AS (SELECT sector, ticker, round(share - share_before, 2) AS change FROM t) SELECT sector, ticker, change, 'Market Share' AS category, CASE WHEN change <= -2 THEN 'High' ELSE 'Medium' END AS severity,
  CASE WHEN change < 0 THEN 'risk' ELSE 'opportunity' END AS direction FROM c WHERE change <= -0.75 OR change >= 0.75""")
def share_warnings(spark: SparkSession, d: str) -> DataFrame:
    got = series.market_share(_sector_series(spark, d)).withColumn("change", F.round("change", 2)).where("change <= -0.75 or change >= 0.75")
    return _rounded(got.select("sector", "ticker", "change", F.lit("Market Share").alias("category"), F.when(F.col("change") <= -2, "High").otherwise("Medium").alias("severity"), F.when(F.col("change") < 0, "risk").otherwise("opportunity").alias("direction")), "change")


@query(f"""WITH m AS ({METRICS}), g AS (SELECT ticker, sector, qoq FROM m WHERE qoq IS NOT NULL), s AS (SELECT sector, median(qoq) AS mid, count(*) AS n FROM g GROUP BY 1)
SELECT ticker, g.sector, qoq, mid, qoq <= mid - 10 AS laggard FROM g JOIN s ON g.sector = s.sector WHERE n >= 3""")
def growth_laggards(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics(spark, d).select("ticker", "sector", "qoq").where("qoq is not null")
    by = rows.groupBy("sector").agg(F.percentile("qoq", 0.5).alias("mid"), F.count("*").alias("n")).where("n >= 3").drop("n")
    return rows.join(by, "sector").withColumn("laggard", F.col("qoq") <= F.col("mid") - 10)


@query(f"""WITH m AS ({METRICS}), g AS (SELECT ticker, sector, qoq FROM m WHERE qoq IS NOT NULL), s AS (SELECT sector, median(qoq) AS mid, count(*) AS n FROM g GROUP BY 1), {_SHARE}
SELECT g.ticker, g.sector, 'Growth Laggard' AS category, 'risk' AS direction, 'Medium' AS severity FROM g JOIN s ON g.sector = s.sector WHERE s.n >= 3 AND qoq <= mid - 10 AND g.ticker NOT IN (SELECT ticker FROM t WHERE ticker % 3 <> 0)""")
def growth_laggard_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Companies that trail their sector's median by ten points, of those whose share among peers is not known (here every third)."""
    shared = series.market_share(_sector_series(spark, d)).where("ticker % 3 <> 0").select("ticker")
    found = growth_laggards(spark, d).where("laggard").join(shared, "ticker", "left_anti")
    return found.select("ticker", "sector", F.lit("Growth Laggard").alias("category"), F.lit("risk").alias("direction"), F.lit("Medium").alias("severity"))


@query(f"""WITH m AS ({METRICS}), c AS (SELECT sector, arg_max(ticker, (sales_var, -ticker)) AS challenger, max(sales_var) AS challenger_growth FROM m WHERE sales_var >= 15 GROUP BY 1)
SELECT ticker, m.sector, challenger, challenger_growth, qoq, CASE WHEN qoq IS NULL THEN 'Low' ELSE 'Medium' END AS severity, 'risk' AS direction, 'Competitive Threat' AS category
FROM m JOIN c ON m.sector = c.sector WHERE ticker <> challenger AND (qoq IS NULL OR (qoq < 15 AND qoq < challenger_growth))""")
def competitive_threats(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics(spark, d)
    fast = rows.where("sales_var >= 15").groupBy("sector").agg(F.max_by("ticker", F.struct("sales_var", -F.col("ticker"))).alias("challenger"), F.max("sales_var").alias("challenger_growth"))
    hit = rows.select("ticker", "sector", "qoq").join(fast, "sector").where("ticker <> challenger and (qoq is null or (qoq < 15 and qoq < challenger_growth))")
    return hit.withColumns({"severity": F.when(F.col("qoq").isNull(), "Low").otherwise("Medium"), "direction": F.lit("risk"), "category": F.lit("Competitive Threat")})


@query("""WITH s AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) * 1000 AS volume FROM lineitem GROUP BY 1, 2),
v AS (SELECT part, count(*) FILTER (WHERE close <> 0) AS sessions, avg(close * volume) FILTER (WHERE close > 0 AND volume > 0) / 1e7 AS value FROM s GROUP BY 1)
SELECT part, sessions, round(value, 2) AS advt_cr, CASE WHEN value IS NULL THEN 'unknown' WHEN value < 1 THEN 'illiquid' WHEN value < 5 THEN 'thin' WHEN value < 25 THEN 'adequate' ELSE 'liquid' END AS liquidity_band,
  CASE WHEN value > 0 THEN round(1 / (value * 0.2), 1) END AS days_to_exit_1cr, CASE WHEN value > 0 THEN round(5 / (value * 0.2), 1) END AS days_to_exit_5cr FROM v""")
def traded_value(spark: SparkSession, d: str) -> DataFrame:
    # the tables hold no exchange volume: a thousand shares for each unit sold
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("day")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), (F.sum("l_quantity") * 1000).alias("volume"))
    return series.traded_value(rows, "part")


@query("""WITH p AS (SELECT l_partkey AS part, l_shipdate AS ts, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS close FROM lineitem WHERE l_quantity > 0), y AS (SELECT * FROM p WHERE ts > (SELECT max(ts) FROM p) - INTERVAL 364 DAY),
r AS (SELECT part, min(close) AS low, max(close) AS high, arg_max(close, (ts, l_orderkey, l_linenumber)) AS last FROM y GROUP BY 1)
SELECT part, CAST(round(CAST(low AS DECIMAL(18,6)), 2) AS DOUBLE) AS week52_low, CAST(round(CAST(high AS DECIMAL(18,6)), 2) AS DOUBLE) AS week52_high, round((last - low) / low * 100, 2) AS pct_above_low FROM r WHERE low > 0""")
def price_range(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_quantity > 0").select(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("place"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    # a scalar subquery, so that the filter stands in the scan's stage and not behind a join
    newest = rows.agg(F.max("ts").alias("newest")).scalar()
    return series.price_range(rows.where(F.col("ts") > newest - F.expr("interval 364 days")), "part", "place")


@query("""WITH p AS (SELECT p_brand AS input, l_shipdate AS ts, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS close FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
c AS (SELECT input, count(*) AS sessions, arg_min(close, (ts, l_orderkey, l_linenumber)) AS f, arg_max(close, (ts, l_orderkey, l_linenumber)) AS l FROM p GROUP BY 1),
m AS (SELECT input, (l - f) / abs(f) * 100 AS change FROM c WHERE sessions >= 2)
SELECT input, round(change, 4) AS change, CASE WHEN change IS NULL THEN 'unmeasured' WHEN abs(change) < 5 THEN 'quiet' WHEN abs(change) < 12 THEN 'material' ELSE 'severe' END AS band FROM m""")
def input_cost_moves(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_quantity > 0").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("close", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    got = rows.groupBy(F.col("p_brand").alias("input")).agg(F.count("*").alias("sessions"), F.min_by("close", order).alias("f"), F.max_by("close", order).alias("l")).where("sessions >= 2")
    return got.select("input", coerce.change(F.col("f"), F.col("l")).alias("change")).withColumn("band", coerce.move(F.col("change"))).withColumn("change", F.round("change", 4))


@query("""WITH d AS (SELECT c_mktsegment AS scheme, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS nav FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY day DESC) AS back, count(*) OVER (PARTITION BY scheme) AS n FROM d WHERE nav > 0),
t AS (SELECT scheme, max(n) AS days, max(nav) FILTER (WHERE back = 1) AS v0, max(nav) FILTER (WHERE back = 22) AS v1, max(nav) FILTER (WHERE back = 64) AS v3, max(nav) FILTER (WHERE back = 253) AS v12 FROM r GROUP BY 1),
p AS (SELECT scheme, days, (v0 - v1) / v1 * 100 AS m1, (v0 - v3) / v3 * 100 AS m3, (v0 - v12) / v12 * 100 AS y1 FROM t)
SELECT scheme, days, round(m1, 4) AS m1, round(m3, 4) AS m3, round(y1, 4) AS y1, CASE WHEN m3 IS NULL OR y1 IS NULL THEN 'unknown' WHEN m3 * 4 > y1 * 1.15 THEN 'accelerating' WHEN m3 * 4 < y1 * 0.85 THEN 'decelerating' ELSE 'steady' END AS trend FROM p""")
def nav_trailing_returns(spark: SparkSession, d: str) -> DataFrame:
    nav = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("scheme"), F.to_date("o_orderdate").alias("day")).agg(money("o_totalprice").alias("nav")).where("nav > 0")
    return _rounded(series.accumulation(series.trailing_returns(nav, {"m1": 21, "m3": 63, "y1": 252}), "m3", "y1"), "m1", "m3", "y1")


_GRAHAM = "CASE WHEN eps > 0 AND NOT coalesce(q_eps < 0, false) AND NOT coalesce(q_opm < 0, false) THEN round(eps * ((8.5 + 2 * CASE WHEN ttm IS NULL THEN 6.0 ELSE least(greatest(ttm, 0.0), 15.0) END) * (4.4 / 7.0)), 1) ELSE 0.0 END"
VALUED = f"WITH {_GROWTH}, m0 AS ({METRICS}), m AS (SELECT m0.*, ttm FROM m0 LEFT JOIN g ON m0.ticker = g.ticker)"
_UPSIDE = f"CASE WHEN price > 0 AND ({_GRAHAM}) > 0 THEN least(greatest((({_GRAHAM}) - price) / price * 100, -50.0), 60.0) END"


@query(f"""{VALUED} SELECT ticker, {_GRAHAM} AS graham_value, round({_UPSIDE}, 4) AS upside, CAST(CASE WHEN roce > 15 THEN 1 ELSE 0 END + CASE WHEN roe > 15 THEN 1 ELSE 0 END + CASE WHEN debt / (0.5 * value) < 0.5 THEN 1 ELSE 0 END AS INT) AS moat_points,
  price < net_assets / CASE WHEN price > 0 THEN value / price ELSE 1.0 END AS is_bargain FROM m WHERE value > 0""")
def intrinsic_value(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.graham(_valued(spark, d).where("value > 0"))
    return _rounded(rows.select("ticker", "graham_value", "upside", rules.moat_points().alias("moat_points"), rules.below_net_assets().alias("is_bargain")), "upside")


@query(f"""{VALUED} SELECT ticker, sector, CASE WHEN analysts > 0 AND target > 0 AND price > 0 THEN 'Analyst Consensus' WHEN {_UPSIDE} IS NOT NULL THEN 'Fundamental Estimate' ELSE 'No Estimate' END AS method,
  round(CASE WHEN analysts > 0 AND target > 0 AND price > 0 THEN (target - price) / price * 100 ELSE {_UPSIDE} END, 4) AS potential FROM m""")
def potential_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rules.potential(_valued(spark, d)), "potential")


@query(f"""{VALUED}, v AS (SELECT *, {_GRAHAM} AS g FROM m)
SELECT ticker, concat_ws(';', CASE WHEN current_ratio < 2 THEN 'Fails Current Ratio (< 2.0)' END, CASE WHEN debt > net_assets THEN 'Fails Debt Limit (Debt > Net Assets)' END,
  CASE WHEN pe > 15 AND NOT price <= g * 1.2 THEN 'Fails P/E Screen (P/E ' || CAST(pe AS VARCHAR) || ' > 15 & Price > Intrinsic)' END, CASE WHEN dividend = 0 THEN 'No Dividend Yield' END,
  CASE WHEN pe > 30 AND (revenue_last < revenue_before OR coalesce(qoq < 15, false)) THEN 'Hyper-Growth Reality Check (P/E > 30 & revenue growth decelerating)' END) AS alerts FROM v""")
def valuation_alerts(spark: SparkSession, d: str) -> DataFrame:
    return rules.valuation_alerts(_valued(spark, d)).select("ticker", F.concat_ws(";", "alerts").alias("alerts"))


@query(f"WITH m AS ({METRICS}) {_WARN}")
def rule_engine(spark: SparkSession, d: str) -> DataFrame:
    return rules.warnings(metrics(spark, d))


def _before(spark: SparkSession, d: str) -> DataFrame:
    """The run before: the warnings of the company one up, where its ticker is no multiple of four."""
    return rules.warnings(metrics(spark, d)).where("ticker % 4 <> 0").withColumn("ticker", F.col("ticker") + 1)


_STATUS = f"""m AS ({METRICS}), w AS ({_WARN}), b AS (SELECT ticker + 1 AS ticker, category, severity AS was FROM w WHERE ticker % 4 <> 0),
st AS (SELECT w.*, CASE WHEN was IS NULL THEN 'new' WHEN {_RANK.format("severity")} < {_RANK.format("was")} THEN 'escalated' ELSE 'ongoing' END AS status FROM w LEFT JOIN b ON w.ticker = b.ticker AND w.category = b.category)"""


@query(f"WITH {_STATUS} SELECT ticker, sector, category, direction, severity, status FROM st")
def warning_status_diff(spark: SparkSession, d: str) -> DataFrame:
    return rules.with_status(rules.warnings(metrics(spark, d)), _before(spark, d)).select("ticker", "sector", "category", "direction", "severity", "status")


@query(f"WITH {_STATUS} SELECT category, severity, count(*) AS n, count(DISTINCT ticker) AS n_tickers FROM st WHERE status = 'ongoing' GROUP BY 1, 2")
def ongoing_summary(spark: SparkSession, d: str) -> DataFrame:
    return warning_status_diff(spark, d).where("status = 'ongoing'").groupBy("category", "severity").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("n_tickers"))


@query(f"WITH {_STATUS} SELECT sector, CAST(sum(CASE WHEN status = 'ongoing' THEN 0 ELSE 4 - {_RANK.format('severity')} END) AS BIGINT) AS delta FROM st GROUP BY 1")
def sector_delta(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("status") == "ongoing", 0).otherwise(4 - coerce.severity_rank(F.col("severity")))
    return warning_status_diff(spark, d).groupBy("sector").agg(F.sum(weight).alias("delta"))


_REVISED = """p AS (SELECT ticker + 1 AS ticker, target AS was, analysts AS n, rec AS r FROM m), rv AS (SELECT m.ticker, m.sector, round((target - was) / was * 100, 2) AS target_change_pct, CAST(analysts - n AS INT) AS analyst_count_change, round(rec - r, 2) AS rec_score_change,
  CASE WHEN target > was THEN 'up' ELSE 'down' END AS direction FROM m JOIN p ON m.ticker = p.ticker WHERE was <> 0 AND target IS NOT NULL)"""


@query(f"""WITH m AS ({METRICS}), w AS ({_WARN}), {_REVISED}, r AS (SELECT ticker, count(*) FILTER (WHERE severity = 'Critical') AS c, count(*) FILTER (WHERE severity = 'High') AS h, count(*) FILTER (WHERE severity IN ('Medium', 'Low')) AS o FROM w WHERE direction = 'risk' GROUP BY 1),
x AS (SELECT m.ticker, m.sector, coalesce(c, 0) AS critical, coalesce(h, 0) AS high, coalesce(o, 0) AS other, coalesce(direction = 'down' AND abs(target_change_pct) >= 10, false) AS cut FROM m LEFT JOIN r ON m.ticker = r.ticker LEFT JOIN rv ON m.ticker = rv.ticker),
y AS (SELECT *, CASE WHEN critical > 0 OR high >= 2 THEN 2 WHEN high = 1 OR other >= 2 THEN 1 ELSE 0 END + CAST(cut AS INT) AS worse FROM x)
SELECT ticker, sector, critical, high, other, cut, CASE worse WHEN 0 THEN 'Intact' WHEN 1 THEN 'Weakening' ELSE 'Broken' END AS health FROM y""")
def thesis_health(spark: SparkSession, d: str) -> DataFrame:
    companies = metrics(spark, d)
    return rules.thesis_health(companies, rules.warnings(companies), revision_momentum(spark, d))


@query(f"""WITH m AS ({METRICS}), l AS (SELECT *, coalesce(pledged_change >= 0.5, false) AS rising, coalesce(above_low BETWEEN 0 AND 20, false) AS near_low FROM m)
SELECT ticker, round(pledged, 2) AS pledged_pct, rising, near_low, CASE WHEN pledged IS NULL THEN 'not_disclosed' WHEN pledged <= 0 THEN 'none' WHEN pledged >= 40 THEN 'severe' WHEN pledged >= 15 THEN 'high' WHEN pledged >= 5 OR rising THEN 'notable' ELSE 'none' END AS status,
  CASE WHEN pledged IS NULL OR pledged <= 0 THEN NULL WHEN pledged >= 40 THEN 'Critical' WHEN pledged >= 15 THEN CASE WHEN rising OR near_low THEN 'Critical' ELSE 'High' END
  WHEN pledged >= 5 THEN CASE WHEN rising AND near_low THEN 'High' ELSE 'Medium' END WHEN rising THEN 'Medium' END AS severity FROM l""")
def pledge_verdict(spark: SparkSession, d: str) -> DataFrame:
    return rules.pledge_verdict(metrics(spark, d))


@query(f"""WITH m AS ({METRICS}), b AS (SELECT *, round(CASE WHEN profit_var BETWEEN -95 AND 150 THEN profit_var WHEN sales_var BETWEEN -95 AND 150 THEN sales_var END, 1) AS growth_pct FROM m),
x AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY growth_pct DESC, ticker) AS rank FROM b WHERE value >= 1000 AND share >= 1 AND growth_pct >= 15)
SELECT sector, ticker, growth_pct, CASE WHEN coalesce(round(profit_var, 1) = growth_pct, false) THEN 'profit growth' ELSE 'revenue growth' END AS basis, rank FROM x WHERE rank <= 3""")
def candidate_screen(spark: SparkSession, d: str) -> DataFrame:
    return rules.candidates(metrics(spark, d).withColumnRenamed("value", "market_cap"))


@query(f"""{VALUED}, v AS (SELECT ticker, sector, price, target, {_GRAHAM} AS g FROM m WHERE analysts > 0 AND target > 0 AND price > 0), x AS (SELECT *, round((g - target) / target * 100, 1) AS divergence_pct FROM v WHERE g <> 0 AND g / price BETWEEN 0.33 AND 3)
SELECT ticker, sector, divergence_pct, CASE WHEN divergence_pct > 0 THEN 'more_bullish' ELSE 'more_bearish' END AS direction FROM x WHERE abs(divergence_pct) >= 15""")
def variant_perception(spark: SparkSession, d: str) -> DataFrame:
    return rules.variant_perception(rules.graham(_valued(spark, d)))


@query(f"WITH m AS ({METRICS}), {_REVISED} SELECT * FROM rv WHERE abs(target_change_pct) >= 3")
def revision_momentum(spark: SparkSession, d: str) -> DataFrame:
    now = metrics(spark, d).select("ticker", "sector", "target", "analysts", "rec")
    return rules.revisions(now, now.withColumn("ticker", F.col("ticker") + 1))


@query("""WITH l AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE o_totalprice / 20 END AS DOUBLE) AS paid, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE c_acctbal END AS now, o_totalprice / 20 * (0.8 + (o_orderkey % 7) / 10.0) AS target FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
a AS (SELECT max(day) AS today FROM l), s AS (SELECT *, date_diff('day', day, today) AS age, CASE WHEN paid <> 0 THEN round((now - paid) / paid * 100, 1) + 0.0 END AS realized, CASE WHEN paid <> 0 THEN round((target - paid) / paid * 100, 1) END AS anticipated FROM l CROSS JOIN a)
SELECT id, CASE WHEN age >= 45 AND now IS NOT NULL THEN realized END AS realized_return_pct, CASE WHEN age < 45 THEN 'pending' WHEN now IS NULL THEN 'Left Watchlist (unscored)' WHEN coalesce(anticipated > 0 AND realized >= 0.5 * anticipated, false) THEN 'Thesis Playing Out' ELSE 'Underperforming' END AS outcome FROM s""")
def decision_scoring(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    today = orders.agg(F.max("date").alias("today"))  # one row
    rows = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(today))
    ledger = rows.select(
        F.col("o_orderkey").alias("id"), "date", "today", F.when(F.col("o_orderkey") % 37 == 0, 0).otherwise(F.col("o_totalprice") / 20).cast("double").alias("price_at_decision"),
        F.expr("o_totalprice / 20 * (0.8D + (o_orderkey % 7) / 10.0D)").alias("target_at_decision"), F.when(F.col("o_orderkey") % 29 != 0, F.col("c_acctbal")).alias("price"),
    )
    return rules.scored_decisions(ledger).select("id", "realized_return_pct", "outcome")


@query(f"WITH x AS ({SQL['decision_scoring']}) SELECT count(*) FILTER (WHERE outcome IN ('Thesis Playing Out', 'Underperforming')) AS total_scored, count(*) FILTER (WHERE outcome = 'Thesis Playing Out') AS wins, round(100.0 * count(*) FILTER (WHERE outcome = 'Thesis Playing Out') / count(*) FILTER (WHERE outcome IN ('Thesis Playing Out', 'Underperforming')), 1) AS win_rate_pct FROM x")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    judged, wins = F.count_if(F.col("outcome").isin("Thesis Playing Out", "Underperforming")), F.count_if(F.col("outcome") == "Thesis Playing Out")
    return decision_scoring(spark, d).agg(judged.alias("total_scored"), wins.alias("wins"), F.round(F.try_divide(wins * 100.0, judged), 1).alias("win_rate_pct"))


@query("SELECT p_name AS name, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_holdings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key")).where("n > 1")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 0 ELSE 1 END AS run FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY run, ts, event_id) AS k FROM e)
SELECT user_id, event_type, event_id, run FROM r WHERE k = 1""")
def history_merge(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    newer = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    return sets.history_merge(events.where(newer), events.where(~newer), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "run")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return sets.last_wins(table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"])


@query("""WITH u AS (SELECT 0 AS source, c_nationkey AS nation, c_custkey AS id FROM customer UNION ALL SELECT 1, s_nationkey, s_suppkey FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY nation, id ORDER BY source) AS k FROM u)
SELECT source, nation, id FROM r WHERE k = 1""")
def priority_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "customer").select(F.lit(0).alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    two = table(spark, d, "supplier").select(F.lit(1).alias("source"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return sets.first_of(one.unionByName(two), ["nation", "id"], [F.col("source")])


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, s_name) AS name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def isin_left_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"))
    return sets.fill_from(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id", "name")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def new_listing_anti(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def known_symbol_semi(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "part").join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))


@query("WITH x AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT p.s AS a, q.s AS b, count(*) AS n_groups FROM x p JOIN x q ON p.o = q.o AND p.s < q.s GROUP BY 1, 2")
def pair_self_join(spark: SparkSession, d: str) -> DataFrame:
    return sets.pairs_within(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
t AS (SELECT src, dst, s_suppkey AS ticker, row_number() OVER (PARTITION BY src, dst ORDER BY s_suppkey) AS rank FROM e JOIN supplier ON dst = s_nationkey) SELECT * FROM t WHERE rank <= 3""")
def edge_routing_top3(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = sold.select(F.col("l_suppkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()
    # a sector's first three once, before they meet the edges
    first = sets.top_of(table(spark, d, "supplier").select(F.col("s_nationkey").alias("dst"), F.col("s_suppkey").alias("ticker")), ["dst"], [F.col("ticker")], 3)
    return edges.join(first, "dst").select("src", "dst", "ticker", "rank")


@query("WITH a AS (SELECT max(CAST(ts AS DATE)) AS today FROM events) SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN 'Medium' ELSE 'none' END AS severity FROM events CROSS JOIN a WHERE event_type = 'error' AND date_diff('day', CAST(ts AS DATE), today) < 14 GROUP BY 1")
def supply_stress(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    today = events.agg(F.max("day").alias("today"))  # one row
    recent = events.where("event_type = 'error'").join(F.broadcast(today), F.date_diff("today", "day") < 14)
    return recent.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("severity", F.when(F.col("n") >= 2, "Medium").otherwise("none"))


@query("""WITH p AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS pts FROM events), b AS (SELECT *, coalesce(sum(pts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM p)
SELECT user_id, count(*) AS n_counted, CAST(least(sum(pts), 8) AS BIGINT) AS total FROM b WHERE bef < 8 GROUP BY 1""")
def policy_points_cap(spark: SparkSession, d: str) -> DataFrame:
    points = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return sets.capped_total(table(spark, d, "events").select("user_id", "event_id", "ts", points.alias("pts")), ["user_id"], ["ts", "event_id"], "pts", 8)


@query(f"WITH q AS ({QUARTERS}), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS back FROM q), x AS (SELECT ticker, max(sales) FILTER (WHERE back = 1) AS a, max(sales) FILTER (WHERE back = 2) AS b, max(sales) FILTER (WHERE back = 3) AS c FROM r GROUP BY 1) SELECT ticker, coalesce(a < b AND b < c, false) AS compressed FROM x")
def persistent_compression(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("sales")))
    got = series.from_end(sales_series(spark, d), ["ticker"], "period").where("back <= 3").groupBy("ticker").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    return got.select("ticker", F.coalesce((F.col("a") < F.col("b")) & (F.col("b") < F.col("c")), F.lit(False)).alias("compressed"))


@query(f"""WITH m AS ({METRICS}), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE price > 0) AS priced, count(*) FILTER (WHERE eps > 0) AS funded, count(*) FILTER (WHERE growth > 0) AS grown FROM m)
SELECT total, priced, funded, grown, round((priced + funded + grown) / (3.0 * total), 4) AS completeness, priced >= 0.6 * total AND funded >= 0.5 * total AS healthy FROM c""")
def run_health(spark: SparkSession, d: str) -> DataFrame:
    got = metrics(spark, d).agg(F.count("*").alias("total"), *[F.count_if(F.col(c) > 0).alias(name) for c, name in (("price", "priced"), ("eps", "funded"), ("growth", "grown"))])
    return got.withColumns({"completeness": F.round(F.expr("try_divide(priced + funded + grown, 3.0D * total)"), 4), "healthy": F.expr("priced >= 0.6 * total and funded >= 0.5 * total")})


@query("WITH h AS (SELECT doc_id, lower(text) AS t FROM documents), c AS (SELECT doc_id, trim(regexp_replace(t, '[^a-z0-9 ]+', '', 'g')) AS k FROM h) SELECT md5(coalesce(k, '')) AS key_md5, min(doc_id) AS doc_id, count(*) AS n FROM c GROUP BY 1")
def headline_dedup(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.coalesce(coerce.dedup_key(F.col("text")), F.lit("")))
    return table(spark, d, "documents").groupBy(key.alias("key_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9&.'']+')) AS BIGINT) AS n_tokens, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9&.'']+'), lambda x: lower(x)))) AS BIGINT) AS n_distinct FROM documents WHERE text IS NOT NULL")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.regexp_extract_all("text", F.lit("[A-Za-z0-9&.']+"), F.lit(0))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(F.transform(tokens, lambda x: F.lower(x)))).cast("long").alias("n_distinct"))


@query("""SELECT event_id, TRY_CAST(nullif(regexp_replace(trim(raw), '[%+,]', '', 'g'), '') AS DOUBLE) AS number, raw FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' +1,' || CAST(event_id AS VARCHAR) || '.5% ' WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN '-' || CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS raw FROM events)""")
def numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" +1,"), key, F.lit(".5% "))).when(F.col("event_id") % 5 == 1, "N/A").when(F.col("event_id") % 5 == 2, "").when(F.col("event_id") % 5 == 3, F.concat(F.lit("-"), key)).otherwise(key)
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", coerce.to_number(F.col("raw")).alias("number"), "raw")


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd'T'10:00:00")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Thu, "), F.date_format(day, "dd MMM yyyy"), F.lit(" 10:58:52 GMT"))).otherwise(F.date_format(day, "dd-MM-yyyy"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), coerce.to_day(raw).alias("day"))


@query("WITH x AS (SELECT doc_id, unnest(string_split_regex(text, '\\s*[;–—]\\s*|\\s+-\\s+|\\s*\\|\\s*')) AS c FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, count(*) AS n FROM x WHERE trim(c, ' ') <> '' GROUP BY 1) SELECT d.doc_id, CAST(coalesce(n.n, CASE WHEN d.text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_clauses FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id WHERE d.text IS NOT NULL")
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(coerce.clauses(F.col("text"))).cast("long").alias("n_clauses"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    spark = with_checkpoints(spark)
    return incremental.drained(incremental.first_seen(incremental.event_stream(spark, d).select("ts", "user_id", "event_type"), ["user_id", "event_type"]), spark.sparkContext._jsc.sc().getCheckpointDir().get())


@query("""WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'), w AS (SELECT event_type, day - CAST(k AS INTEGER) AS start FROM e CROSS JOIN range(14) t(k))
SELECT event_type, strftime(start, '%Y-%m-%d') AS start, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding_stress(spark: SparkSession, d: str) -> DataFrame:
    spark = with_checkpoints(spark)
    errors = incremental.event_stream(spark, d).where("event_type = 'error'").select("ts", "event_type")
    found = incremental.drained(incremental.sliding_counts(errors, "event_type"), spark.sparkContext._jsc.sc().getCheckpointDir().get(), "complete")
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd"))
