"""Registered queries over what a dashboard is given, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import coerce
from marketlens.operators import display
from marketlens.plans import catalogue, curation, news, research
from marketlens.plans.catalogue import METRICS, query
from marketlens.sources.tables import metrics, table

_NAMES = {"agreements": "corporate_agreements", "launches": "product_launches", "filings": "corporate_filings", "global": "global_market_news"}
_CAP = f"CASE feed {' '.join(f"WHEN '{f}' THEN {n}" for f, n in display.FEED_CAPS.items())} END"


@query(f"""{research._TRACKED}, {news._COLLECTED}, fd AS (SELECT CASE feed {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _NAMES.items())} ELSE sector END AS feed, id AS place FROM it UNION ALL SELECT 'market_events', id FROM me),
rk AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY place) AS r, {_CAP} AS cap FROM fd) SELECT feed, place, CASE WHEN cap IS NOT NULL THEN r END AS rank FROM rk WHERE cap IS NULL OR r <= cap""")
def display_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each feed that are shown; sectors' own feeds are shown whole."""
    feed = F.expr(f"CASE feed {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _NAMES.items())} ELSE sector END")
    events = research._market_events(spark, d).select(F.lit("market_events").alias("feed"), F.col("id").alias("place"))
    return display.capped(news._items(spark, d).select(feed.alias("feed"), "place").unionByName(events))


@query(f"WITH {catalogue._STATUS} SELECT ticker, category, severity, status FROM st WHERE status IN ('new', 'escalated')")
def actionable_warnings(spark: SparkSession, d: str) -> DataFrame:
    return display.actionable(catalogue.warning_status_diff(spark, d)).select("ticker", "category", "severity", "status")


@query(f"WITH {catalogue._STATUS} SELECT category, severity, min(direction) AS direction, count(*) AS n, string_agg(DISTINCT CAST(ticker AS VARCHAR), '; ' ORDER BY CAST(ticker AS VARCHAR)) AS tickers FROM st WHERE status = 'ongoing' GROUP BY 1, 2")
def standing_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What has not changed, a row for each category and severity with all of its companies."""
    return display.standing(catalogue.warning_status_diff(spark, d)).select("category", "severity", "direction", "n", F.array_join("tickers", "; ").alias("tickers"))


_TICKER = "'T' || CAST({} AS VARCHAR)"


@query(f"""WITH rv AS ({catalogue.SQL['revision_momentum']}), th AS ({catalogue.SQL['thesis_health']}), dc AS ({catalogue.SQL['decision_scoring']}), cd AS ({catalogue.SQL['rotation_decisions']}), ne AS ({catalogue.SQL['new_entrants']}), wr AS ({catalogue.SQL['rule_engine']}),
mx AS ({METRICS}), inc AS (SELECT sector, string_agg({_TICKER.format('ticker')}, ', ' ORDER BY ticker) AS incumbents FROM (SELECT sector, ticker FROM mx QUALIFY row_number() OVER (PARTITION BY sector ORDER BY ticker) <= 3) GROUP BY 1),
ld AS (SELECT {_TICKER.format('o_custkey')} AS ticker, id, CASE WHEN id % 2 = 0 THEN 'rotated in' ELSE 'added' END AS action, CASE WHEN id % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS price, CAST(o_orderdate AS DATE) AS date, CASE WHEN outcome <> 'pending' THEN outcome END AS outcome FROM dc JOIN orders ON id = o_orderkey),
al AS (SELECT 'Analyst targets moved' AS "group", row_number() OVER (ORDER BY abs(target_change_pct) DESC, {_TICKER.format('ticker')}) AS place, 6 AS k, {_TICKER.format('ticker')} || ' consensus target ' || CASE WHEN direction = 'up' THEN 'raised' ELSE 'cut' END || ' ' || CASE WHEN target_change_pct > 0 THEN '+' ELSE '' END || regexp_replace(CAST(CAST(target_change_pct AS DECIMAL(28,2)) AS VARCHAR), '\\.?0+$', '') || '%' AS text FROM rv
  UNION ALL SELECT 'Theses broken', row_number() OVER (ORDER BY ticker), 6, {_TICKER.format('ticker')} || ' thesis broken ' || CAST(critical AS VARCHAR) || ' critical, ' || CAST(high AS VARCHAR) || ' high' FROM th WHERE health = 'Broken'
  UNION ALL SELECT 'Watchlist changes', row_number() OVER (ORDER BY date DESC, id), 6, ticker || ' ' || action || coalesce(' at ' || CAST(price AS VARCHAR), '') || ' ' || CAST(date AS VARCHAR) || ' — ' || coalesce(outcome, 'not yet scored') FROM ld
  UNION ALL SELECT 'Deferred candidates', row_number() OVER (ORDER BY pos), 5, coalesce(ticker, name) || ' held for a later run' FROM cd WHERE status = 'Deferred'
  UNION ALL SELECT 'New entrants', row_number() OVER (ORDER BY id, ne.sector, challenger), 4, challenger || ' entering ' || ne.sector || ' — pressures ' || incumbents FROM ne JOIN inc ON inc.sector = ne.sector
  UNION ALL SELECT 'Critical alerts', row_number() OVER (ORDER BY {_TICKER.format('ticker')}, category), 6, {_TICKER.format('ticker')} || ' ' || category FROM wr WHERE severity = 'Critical')
SELECT "group", place, text FROM al WHERE place <= k""")
def whats_new(spark: SparkSession, d: str) -> DataFrame:
    """What moved in this run."""
    named = F.concat(F.lit("T"), F.col("ticker").cast("string")).alias("ticker")
    revisions = catalogue.revision_momentum(spark, d).select(named, "direction", "target_change_pct")
    theses = catalogue.thesis_health(spark, d).where("health = 'Broken'").select(named, F.col("ticker").alias("place"), "health", F.format_string("%d critical, %d high", "critical", "high").alias("reason"))
    scored = catalogue.decision_scoring(spark, d).join(table(spark, d, "orders"), F.col("id") == F.col("o_orderkey")).withColumn("date", F.to_date("o_orderdate"))
    ledger = scored.select(
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"), F.struct((-F.unix_date("date")).alias("newest"), "id").alias("place"), F.when(F.col("id") % 2 == 0, "rotated_in").otherwise("added").alias("action"),
        F.when(F.col("id") % 5 != 0, F.floor("o_totalprice")).alias("price"), "date", F.when(F.col("outcome") != "pending", F.col("outcome")).alias("outcome"),
    )
    first = display.top_of(metrics(spark, d).select("sector", "ticker"), ["sector"], [F.col("ticker")], 3).groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("rank", named))).alias("l"))
    entrants = research.new_entrants(spark, d).join(first, "sector").select(F.col("id").alias("place"), "sector", "challenger", F.transform("l", lambda x: x["ticker"]).alias("incumbents"))
    warned = catalogue.rule_engine(spark, d).select(named, "category", "severity", F.lit(None).cast("string").alias("signal"))
    return display.whats_new(revisions, theses, ledger, curation.rotation_decisions(spark, d).withColumnRenamed("pos", "place"), entrants, warned).select("group", "place", "text")


# figures at, above and below a tie, as thousandths, eighths and quotients
_FIGURES = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 100000 AS DOUBLE) / CAST(1000 AS DOUBLE) WHEN 1 THEN CAST(o_orderkey % 5000 AS DOUBLE) / CAST(8 AS DOUBLE) - CAST(250 AS DOUBLE) WHEN 2 THEN o_totalprice / CAST(o_orderkey % 9 + 1 AS DOUBLE) ELSE CAST(20 AS DOUBLE) - o_totalprice / CAST(1000 AS DOUBLE) END"


@query(f"SELECT o_orderkey AS id, printf('%.2f', x) AS money, CASE WHEN x > 0 THEN '+' ELSE '' END || printf('%.1f', x) || '%' AS percent FROM (SELECT o_orderkey, {_FIGURES} AS x FROM orders)")
def wire_values(spark: SparkSession, d: str) -> DataFrame:
    """Figures as they are shown: money with two digits, percentages with one and a sign."""
    x = F.expr(_FIGURES)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), coerce.wire_money(x).alias("money"), coerce.wire_percent(x).alias("percent"))


_STAMPS = ("dd-MMM-yyyy '17:30:00'", "dd-MMM-yyyy", "yyyy-MM-dd '09:05:01'", "yyyy-MM-dd", "yyyy-MM-dd'T15:41:54.000Z'", "dd MMM yyyy '15:41:54'", "dd MMM yyyy", "dd/MM/yyyy", "yyyyMMdd", "dd-MM-yyyy")
_READ_NSE, _READ_BSE = (0, 1, 2, 3), (0, 2, 3, 4, 5, 6, 7)
_SPELLED = ("'%d-%b-%Y 17:30:00'", "'%d-%b-%Y'", "'%Y-%m-%d 09:05:01'", "'%Y-%m-%d'", "'%Y-%m-%dT15:41:54.000Z'", "'%d %b %Y 15:41:54'", "'%d %b %Y'", "'%d/%m/%Y'", "'%Y%m%d'", "'%d-%m-%Y'")


@query(f"""WITH s AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 11 AS shape, CASE o_orderkey % 11 {' '.join(f'WHEN {i} THEN strftime(CAST(o_orderdate AS DATE), {f})' for i, f in enumerate(_SPELLED))} END AS raw FROM orders)
SELECT id, CASE WHEN shape IN {_READ_NSE} THEN strftime(day, '%d %b %Y') ELSE coalesce(raw, '') END AS nse, CASE WHEN shape IN {_READ_BSE} THEN strftime(day, '%d %b %Y') ELSE coalesce(raw, '') END AS bse FROM s""")
def filing_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of ten forms and none, as each exchange's reader shows them."""
    day = F.col("o_orderdate").cast("date")
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % 11 == i, F.date_format(day, f)) for i, f in enumerate(_STAMPS)])
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), coerce.nse_stamp(raw).alias("nse"), coerce.bse_stamp(raw).alias("bse"))
