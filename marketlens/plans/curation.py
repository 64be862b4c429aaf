"""Registered queries over what runs leave behind: the watchlist's rotation, kept tables, and streams that keep them.

Each is beside the SQL that gives the same rows from the tables at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.headlines import EVENTS
from marketlens.operators import briefing, rotation
from marketlens.plans import catalogue, research
from marketlens.plans.catalogue import _RANK, _STATUS, METRICS, query
from marketlens.plans.research import _CORPUS, _ISSUED, _MATCHED, _TITLE, _companies, _turf
from marketlens.session import with_checkpoints
from marketlens.sources import files, publish
from marketlens.sources.tables import metrics, table
from marketlens.streaming import incremental, state, stores


def _shared(spark: SparkSession) -> str:
    """A new folder where driver and executors can write."""
    return f"{with_checkpoints(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


_CALLED = "CASE o_orderkey % 6 WHEN 0 THEN 'Omega' || CAST(o_custkey % 8 AS STRING) || ' Works Ltd wins order' WHEN 1 THEN 'Shri Kumar launches scheme' WHEN 2 THEN 'Beta' || CAST(o_custkey % 30 * 3 + 1 AS STRING) || ' bags order' WHEN 3 THEN 'Delta' || CAST(o_custkey % 5 AS STRING) || ' Solutions and Delta' || CAST(o_custkey % 3 AS STRING) || ' Corp partners' WHEN 4 THEN 'AB expands' ELSE 'nothing wins' END"
_NEW = f"""{_ISSUED}, ct AS (SELECT o_orderkey AS id, r_name AS sector, {_CALLED} AS title FROM orders JOIN supplier ON s_suppkey = o_custkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
kn AS (SELECT DISTINCT lower(unnest(list_concat([ticker, name], list_filter(string_split_regex(name, '\\s+'), lambda x: length(x) > 3)))) AS known FROM co),
pa AS (SELECT sector, id, 0 AS arm, unnest(regexp_extract_all(title, '{rotation.WITH_SUFFIX}', 1)) AS word, unnest(regexp_extract_all(title, '{rotation.WITH_SUFFIX}', 0)) AS name, unnest(range(0, len(regexp_extract_all(title, '{rotation.WITH_SUFFIX}', 0)))) AS k FROM ct
  UNION ALL SELECT sector, id, 1, unnest(regexp_extract_all(title, '{rotation.WITH_VERB}', 1)), unnest(regexp_extract_all(title, '{rotation.WITH_VERB}', 1)), unnest(range(0, len(regexp_extract_all(title, '{rotation.WITH_VERB}', 1)))) FROM ct),
em AS (SELECT sector, name, min(id) AS id, arg_min(arm * 100 + k, (id, arm, k)) AS k FROM pa WHERE length(word) >= 3 AND NOT list_has_any(string_split(lower(word), ' '), [{research._IN(rotation.NO_NAMES)}]) AND lower(word) NOT IN (SELECT known FROM kn) GROUP BY 1, 2)"""


def _emerging(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = table(spark, d, "orders").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("o_custkey")).join(region, F.col("s_nationkey") == F.col("n_nationkey"))
    return rotation.emerging(rows.select(F.col("r_name").alias("sector"), F.col("o_orderkey").alias("id"), F.expr(_CALLED).alias("title")), _companies(spark, d))


@query(f"WITH {_NEW} SELECT sector, name, id FROM em")
def emerging_players(spark: SparkSession, d: str) -> DataFrame:
    """Companies that headlines tell of and nobody follows, with the first headline of each region."""
    return _emerging(spark, d).select("sector", "name", "id")


# regions are the sectors of the watchlist; every second company is on it, of one region only a few
_HELD = "ticker % 2 = 0 AND (region <> 'ASIA' OR ticker < 20)"
_SYMBOL = "CASE WHEN no % 4 <> 3 THEN 'T' || CAST(no * 2 + 1 AS STRING) END"
_ROUNDS = f"""WITH {_NEW}, mx AS ({METRICS}), h0 AS (SELECT region AS sector, ticker AS ord, 'T' || CAST(ticker AS VARCHAR) AS ticker, 'IN' || CAST(ticker AS VARCHAR) AS isin, CAST(growth AS DOUBLE) AS potential FROM mx WHERE {_HELD}),
qt AS (SELECT 'T' || CAST(ticker AS VARCHAR) AS ticker, (CASE WHEN target > 0 THEN target ELSE price * 1.25 END - price) / price * 100 AS growth, sales_var / 100 AS rev, coalesce(qoq, 0) AS qoq, 'IN' || CAST(ticker - CASE WHEN ticker % 10 = 7 THEN 1 ELSE 0 END AS VARCHAR) AS isin, price > 0 AS priced FROM mx),
nm AS (SELECT sector, name, CAST(regexp_extract(name, '[0-9]+') AS BIGINT) AS no, id, k FROM em),
qu AS (SELECT 0 AS kind, 0.0 AS behind, sector, id AS ord, k, name, CASE WHEN no % 4 <> 3 THEN 'T' || CAST(no * 2 + 1 AS VARCHAR) END AS ticker FROM nm WHERE sector IN (SELECT sector FROM h0)
  UNION ALL SELECT 1, -sales_var, region, ticker, 0, name, 'T' || CAST(ticker AS VARCHAR) FROM mx WHERE ticker % 3 = 1 AND region IN (SELECT sector FROM h0)),
tw AS (SELECT isin, arg_min(ticker, (sector, ord)) AS twin FROM h0 GROUP BY 1),
ca AS (SELECT row_number() OVER (ORDER BY kind, behind, qu.sector, ord, k, name) AS pos, qu.sector, name, qu.ticker, CASE WHEN priced THEN growth END AS growth, rev, qt.qoq, CASE WHEN twin <> qu.ticker THEN twin END AS twin, coalesce(priced AND growth > 0 AND NOT coalesce(rev < 0, false) AND qt.qoq >= 15, false) AS eligible
  FROM qu LEFT JOIN qt ON qu.ticker = qt.ticker LEFT JOIN tw ON qt.isin = tw.isin),
f0 AS (SELECT DISTINCT ticker FROM h0), e0 AS (SELECT 0 AS pos)"""
for _i in range(rotation.CAP):
    _ROUNDS += f""", s{_i} AS (SELECT sector, count(*) AS n, arg_min(ticker, (coalesce(potential, 0), ord)) AS weakest, min(coalesce(potential, 0)) AS least FROM h{_i} GROUP BY 1),
e{_i + 1} AS (SELECT pos, ca.sector, ca.ticker, growth, CASE WHEN n >= 5 THEN weakest END AS gone FROM ca JOIN s{_i} s ON ca.sector = s.sector WHERE eligible AND twin IS NULL AND ca.ticker NOT IN (SELECT ticker FROM f{_i}) AND pos > (SELECT max(pos) FROM e{_i}) AND (n < 5 OR growth > least) ORDER BY pos LIMIT 1),
f{_i + 1} AS (SELECT ticker FROM f{_i} WHERE ticker NOT IN (SELECT gone FROM e{_i + 1} WHERE gone IS NOT NULL) UNION SELECT ticker FROM e{_i + 1}),
h{_i + 1} AS (SELECT * FROM h{_i} h WHERE NOT EXISTS (SELECT 1 FROM e{_i + 1} e WHERE e.sector = h.sector AND e.gone = h.ticker) UNION ALL SELECT sector, {10**15 + _i}, ticker, NULL, round(growth, 1) FROM e{_i + 1})"""
_ENDED = " + ".join(f"CASE WHEN ca.pos > coalesce((SELECT pos FROM e{_i + 1}), 9e18) THEN 1 ELSE 0 END" for _i in range(rotation.CAP))
_STATES = " UNION ALL ".join(f"SELECT {_i} AS turn, * FROM (SELECT sector, count(*) AS n, arg_min(ticker, (coalesce(potential, 0), ord)) AS weakest, min(coalesce(potential, 0)) AS least FROM h{_i} GROUP BY 1)" for _i in range(rotation.CAP + 1))
_FOLLOWED = " UNION ALL ".join(f"SELECT {_i} AS turn, ticker FROM f{_i}" for _i in range(rotation.CAP + 1))


@query(f"""{_ROUNDS}, tu AS (SELECT ca.*, {_ENDED} AS turn FROM ca), st AS ({_STATES}), fo AS ({_FOLLOWED}),
vd AS (SELECT tu.*, n, weakest, CASE WHEN tu.turn >= {rotation.CAP} THEN 'Deferred' WHEN tu.ticker IS NULL THEN 'Unresolved' WHEN EXISTS (SELECT 1 FROM fo WHERE fo.turn = tu.turn AND fo.ticker = tu.ticker) THEN 'Watchlisted' WHEN growth IS NULL THEN 'Unresolved' WHEN twin IS NOT NULL THEN 'Watchlisted'
  WHEN NOT eligible THEN 'Growth Divergence' WHEN n < 5 THEN 'added' WHEN growth > least THEN 'rotated_in' ELSE 'Pipeline' END AS v FROM tu LEFT JOIN st ON st.turn = tu.turn AND st.sector = tu.sector)
SELECT pos, sector, name, ticker, CASE WHEN v IN ('added', 'rotated_in') THEN 'Watchlisted' ELSE v END AS status, CASE WHEN v IN ('added', 'rotated_in') THEN v END AS action, CASE WHEN v = 'rotated_in' THEN weakest END AS replaced FROM vd""")
def rotation_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of a run with its verdict, and who joined the watchlist in whose place."""
    companies = metrics(spark, d)
    ticker = F.concat(F.lit("T"), F.col("ticker").cast("string")).alias("ticker")
    held = companies.where(_HELD).select(F.col("region").alias("sector"), F.col("ticker").alias("ord"), ticker, F.expr("'IN' || cast(ticker as string)").alias("isin"), F.col("growth").alias("potential"))
    quotes = companies.select(ticker, "price", F.col("target").alias("target_mean"), (F.col("sales_var") / 100).alias("revenue_growth"), "qoq")
    isins = companies.select(ticker, F.expr("'IN' || cast(ticker - if(ticker % 10 = 7, 1, 0) as string)").alias("isin"))
    screened = companies.where("ticker % 3 = 1").select(F.col("region").alias("sector"), "name", ticker, F.col("sales_var").alias("growth_pct"), F.col("ticker").alias("ord"))
    names = _emerging(spark, d)
    symbols = names.select("name", F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("no")).distinct().select("name", F.expr(_SYMBOL).alias("ticker"))
    found = rotation.curated(rotation.queue(names, screened, symbols, quotes, isins, held), held)
    # the place as a number, for this listing only: candidates of a run are few
    return found.select(F.expr("row_number() over (order by place)").alias("pos"), "sector", "name", "ticker", "status", "action", "replaced")


_DECIDED = "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey % 50 AS VARCHAR) AS ticker, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN o_orderkey % 70 <> 0 THEN o_totalprice END AS price, o_totalprice * 1.2 AS target FROM orders WHERE o_orderkey % 10 = 0"
_QUOTED = "SELECT CAST(o_custkey % 50 AS VARCHAR) AS ticker, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 10 IN (5, 6) AND o_custkey % 50 <> 7"


@query(f"""WITH a AS (SELECT * FROM ({_DECIDED}) WHERE price IS NOT NULL), q AS ({_QUOTED}), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM (SELECT ts FROM a UNION ALL SELECT ts FROM q)),
l AS (SELECT a.id, arg_max_null(q.price, (q.ts, coalesce(q.price, 9e99))) AS price FROM a JOIN q ON a.ticker = q.ticker AND q.ts <= a.ts + INTERVAL 45 DAY GROUP BY 1),
r AS (SELECT a.id, a.ticker, CASE WHEN a.price <> 0 THEN round((l.price - a.price) / a.price * 100, 1) END AS realized, round((target - a.price) / a.price * 100, 1) AS anticipated, l.price AS now FROM a LEFT JOIN l ON a.id = l.id, w WHERE a.ts + INTERVAL 45 DAY < mark)
SELECT id, ticker, realized AS realized_return_pct, CASE WHEN now IS NULL THEN 'Left Watchlist (unscored)' WHEN anticipated > 0 AND realized >= 0.5 * anticipated THEN 'Thesis Playing Out' ELSE 'Underperforming' END AS outcome FROM r""")
def scored_decision_stream(spark: SparkSession, d: str) -> DataFrame:
    """Decisions scored by a timer 45 days later: two streams, of decisions and of prices, both made from orders."""
    orders = incremental.table_stream(spark, d, "orders")
    ticker, ts = (F.col("o_custkey") % 50).cast("string").alias("ticker"), F.col("o_orderdate").cast("timestamp").alias("ts")
    asked = orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"), ticker, ts, F.when(F.col("o_orderkey") % 70 != 0, F.col("o_totalprice")).alias("price"), (F.col("o_totalprice") * 1.2).alias("target"))
    told = incremental.table_stream(spark, d, "orders").where("o_orderkey % 10 in (5, 6) and o_custkey % 50 <> 7").select(ticker, ts, F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"))
    return incremental.drained(state.scored_stream(asked, told), _shared(spark)).select("id", "ticker", "realized_return_pct", "outcome")


def _headline_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = incremental.table_stream(spark, d, "orders").join(_companies(spark, d), F.col("s_suppkey") == F.col("o_custkey"))
    return rows.select(F.col("o_orderkey").cast("string").alias("id"), F.expr(_TITLE).alias("title"), F.expr("date_add(DATE'1998-01-01', cast(o_orderkey * 7 % 181 as int))").alias("day"))


@query(f"{_CORPUS} SELECT CAST(id AS VARCHAR) AS id, day, type, domains, actors FROM rc")
def event_corpus_stream(spark: SparkSession, d: str) -> DataFrame:
    """The corpus of the last 45 days, kept by a stream of headlines."""
    folder = _shared(spark)
    incremental.fed(_headline_stream(spark, d), folder, stores.corpus_keeper(f"{folder}/table", lambda: _turf(spark, d), lambda: _companies(spark, d)))
    return research._lists(publish.read(spark, f"{folder}/table")).select("id", "day", "type", "domains", "actors")


@query(f"""{_MATCHED} SELECT DISTINCT a.ticker AS src, b.ticker AS dst, 'partner' AS type FROM hl JOIN mt a ON hl.id = a.id JOIN mt b ON hl.id = b.id AND a.ticker < b.ticker
WHERE {' OR '.join(f"contains(lower(title), '{p}')" for p in EVENTS['tie_up'])}""")
def graph_growth_stream(spark: SparkSession, d: str) -> DataFrame:
    """The graph that a stream of headlines makes out of nothing: an edge for each two companies that one ties up."""
    folder = _shared(spark)
    incremental.fed(_headline_stream(spark, d), folder, stores.graph_grower(f"{folder}/table", lambda: _companies(spark, d)))
    return stores.in_graph_order(publish.read(spark, f"{folder}/table", "edges")).select("src", "dst", "type")


@query(f"WITH m AS ({METRICS}), w AS ({catalogue._WARN}) SELECT ticker, category, severity FROM w WHERE severity IN ('Critical', 'High')")
def published_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What the dashboard shows of a run's warnings, read back from the version that the run has published."""
    folder = _shared(spark)
    found = catalogue.rule_engine(spark, d)
    files.write_briefing(found, found.where("severity in ('Critical', 'High')"), found.select(F.col("ticker").cast("string").alias("ticker"), "category"), folder)
    return publish.read(spark, folder, "display").select("ticker", "category", "severity")


# warnings with tickers as headlines spell them, and every third company as a peer
_BLOCK_WARNINGS = f"{_STATUS}, wa AS (SELECT 'T' || CAST(ticker AS VARCHAR) AS ticker, sector, category, direction, severity, status, 4 - {_RANK.format('severity')} AS weight FROM st)"
_BLOCKS = f"""WITH {_BLOCK_WARNINGS}, {_MATCHED.removeprefix('WITH ')}, cm AS (SELECT ticker, n_name AS sector, method FROM (SELECT 'T' || CAST(ticker AS VARCHAR) AS ticker, sector AS n_name, method FROM ({catalogue.SQL['potential_estimate']}))),
mo AS (SELECT sector, sum(CASE WHEN status IN ('new', 'escalated') THEN weight ELSE 0 END) AS delta, count(*) FILTER (WHERE status = 'new') AS n_new, count(*) FILTER (WHERE status = 'escalated') AS n_escalated FROM wa GROUP BY 1),
cr AS (SELECT DISTINCT lower(ticker) AS t FROM wa WHERE severity = 'Critical'),
nk AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM cr WHERE contains(lower(title), t)) THEN 0 WHEN regexp_matches(lower(title), 'order|contract') THEN 1 WHEN regexp_matches(lower(title), 'policy|pli|scheme|cabinet|government') THEN 2 WHEN regexp_matches(lower(title), 'tie-up|tie up|partnership|mou|agreement') THEN 3 ELSE 4 END AS rank FROM hl),
nf AS (SELECT sector, id, rank, row_number() OVER (PARTITION BY sector ORDER BY rank, day, id) AS seat FROM nk QUALIFY seat <= 4),
nb AS (SELECT sector, string_agg(CAST(id AS VARCHAR) || ' ' || ['linked_to_critical', 'order_win', 'policy', 'tie_up', 'other'][rank + 1], '; ' ORDER BY seat) AS news, count(*) AS n_news FROM nf GROUP BY 1),
cc AS (SELECT ticker, counted FROM ({catalogue.SQL['coverage_counts']})), tw AS (SELECT sector, ticker, max(weight) AS weight, arg_min(category, (CASE direction WHEN 'risk' THEN 0 ELSE 1 END, 4 - weight, category)) AS signal FROM wa GROUP BY 1, 2),
ff AS (SELECT cm.sector, cm.ticker, coalesce(weight, 0) AS weight, coalesce(signal, 'No signal this cycle') AS signal, coalesce(counted, 0) AS counted, row_number() OVER (PARTITION BY cm.sector ORDER BY coalesce(weight, 0) DESC, coalesce(counted, 0) DESC, cm.ticker) AS seat FROM cm LEFT JOIN tw ON tw.sector = cm.sector AND tw.ticker = cm.ticker LEFT JOIN cc ON cc.ticker = cm.ticker QUALIFY seat <= 3),
fb AS (SELECT sector, string_agg(ticker || ' ' || CAST(weight AS VARCHAR) || ' ' || signal || ' ' || CAST(counted AS VARCHAR), '; ' ORDER BY seat) AS focus FROM ff GROUP BY 1),
th AS (SELECT sector, challenger AS name, 'new entrant' AS detail, 0 AS arm, id AS place FROM ({catalogue.SQL['new_entrants']}) UNION ALL SELECT sector, name, printf('%+.1f%% revenue growth', sales_var), 1, ticker FROM m WHERE ticker % 3 = 0),
tf2 AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY arm, place, name) AS seat FROM th QUALIFY seat <= 2), tb AS (SELECT sector, string_agg(name || ': ' || detail, '; ' ORDER BY seat) AS threats FROM tf2 GROUP BY 1),
sb AS (SELECT sector, string_agg(ticker, '; ' ORDER BY ticker) AS suppressed FROM cm WHERE method = 'No Estimate' GROUP BY 1),
bl AS (SELECT sc.sector, coalesce(delta, 0) AS delta, coalesce(n_new, 0) AS n_new, coalesce(n_escalated, 0) AS n_escalated, coalesce(news, '') AS news, coalesce(n_news, 0) AS n_news, coalesce(focus, '') AS focus, coalesce(threats, '') AS threats, coalesce(suppressed, '') AS suppressed
  FROM (SELECT DISTINCT sector FROM cm) sc LEFT JOIN mo ON mo.sector = sc.sector LEFT JOIN nb ON nb.sector = sc.sector LEFT JOIN fb ON fb.sector = sc.sector LEFT JOIN tb ON tb.sector = sc.sector LEFT JOIN sb ON sb.sector = sc.sector WHERE delta > 0 OR news IS NOT NULL)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat(F.lit("T"), F.col("ticker").cast("string")).alias("ticker")
    told = catalogue.warning_status_diff(spark, d).select(named, "sector", "category", "direction", "severity", "status")
    companies = catalogue.potential_estimate(spark, d).select("sector", named, "method")
    peers = metrics(spark, d).where("ticker % 3 = 0").select("sector", "name", F.col("ticker").cast("string").alias("ticker"), "sales_var", F.col("ticker").alias("place"))
    return briefing.sector_blocks(told, research._headlines(spark, d), companies, research.coverage_counts(spark, d), research.new_entrants(spark, d), peers)


@query(f"""{_BLOCKS} SELECT row_number() OVER (ORDER BY delta DESC, n_news DESC, sector) AS place, sector, CAST(delta AS BIGINT) AS delta, n_new, n_escalated, news, focus, threats, suppressed,
CASE WHEN n_new + n_escalated > 0 THEN CAST(n_new AS VARCHAR) || ' new, ' || CAST(n_escalated AS VARCHAR) || ' escalated' ELSE 'No change this cycle; carrying news only' END AS stance FROM bl""")
def sector_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A block for each sector that moved or has news, with its place, news, focus, threats and what is not estimated."""
    text = lambda c, x: F.coalesce(F.array_join(F.transform(c, x), "; "), F.lit("")).alias(c)
    space = lambda *cs: F.concat_ws(" ", *[c.cast("string") for c in cs])
    # sectors are a dimension of some dozens
    placed = _blocks(spark, d).withColumn("place", F.expr("row_number() over (order by delta desc, coalesce(size(news), 0) desc, sector)"))
    return placed.select(
        "place", "sector", "delta", "n_new", "n_escalated", text("news", lambda x: space(x["id"], x["kind"])), text("focus", lambda x: space(x["ticker"], x["weight"], x["signal"], x["counted"])),
        text("threats", lambda x: F.concat(x["name"], F.lit(": "), x["detail"])), F.coalesce(F.array_join("suppressed", "; "), F.lit("")).alias("suppressed"), "stance",
    )


@query(f"""WITH {_STATUS}, ch AS (SELECT * FROM st WHERE status IN ('new', 'escalated')), pe AS ({catalogue.SQL['potential_estimate']}), hg AS ({catalogue.SQL['holding_growth']}), tz AS ({catalogue.SQL['thesis_health']}),
cv AS (SELECT count(*) AS total, count(*) FILTER (WHERE price <> 0) AS priced, count(*) FILTER (WHERE current_ratio IS NOT NULL) AS figures, count(ttm) AS growth, count(*) FILTER (WHERE method = 'No Estimate') AS suppressed FROM m LEFT JOIN pe ON pe.ticker = m.ticker LEFT JOIN hg ON hg.ticker = m.ticker),
ht AS (SELECT sector, count(*) AS n FROM ch GROUP BY 1 ORDER BY n DESC, sector LIMIT 3)
SELECT CASE WHEN priced / greatest(total, 1) < 0.6 OR figures / greatest(total, 1) < 0.5 THEN 'degraded' WHEN (SELECT count(*) FROM ch) = 0 THEN 'quiet' ELSE 'normal' END AS day_type, CAST(round_even((priced + figures + growth) / (3 * total) * 100, 0) AS INT) AS completeness,
(SELECT count(*) FROM ch WHERE severity = 'Critical' AND direction = 'risk') AS critical_total, (SELECT count(*) FROM st WHERE status = 'escalated') AS escalated_total, (SELECT count(*) FROM ch WHERE direction = 'opportunity') AS opportunities_total, (SELECT count(*) FROM st WHERE status = 'new') AS new_total,
(SELECT count(*) FROM st WHERE status = 'ongoing') AS ongoing_total, (SELECT count(*) FROM (SELECT DISTINCT category, severity FROM st WHERE status = 'ongoing')) AS ongoing_groups, (SELECT count(*) FROM tz WHERE health = 'Broken') AS broken_theses, suppressed, (SELECT string_agg(sector || ' ' || CAST(n AS VARCHAR), '; ' ORDER BY n DESC, sector) FROM ht) AS hot_sectors FROM cv""")
def daily_summary(spark: SparkSession, d: str) -> DataFrame:
    """The day in one row."""
    figures = metrics(spark, d).select("ticker", "price", F.col("current_ratio").isNotNull().alias("has_figures"))
    companies = figures.join(catalogue.potential_estimate(spark, d).select("ticker", "method"), "ticker", "left").join(catalogue.holding_growth(spark, d).select("ticker", "ttm"), "ticker", "left")
    return briefing.daily_summary(catalogue.warning_status_diff(spark, d), companies, catalogue.thesis_health(spark, d))
