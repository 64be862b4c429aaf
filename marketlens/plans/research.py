"""Registered queries over headlines, industries and whole-company scores, each beside its SQL.

The test data has no headlines: they are spelled from orders whose customer number is a company's, in twelve shapes, and
spread over half a year. The vocabularies of sectors are dealt over nations by their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import coerce
from marketlens.functions import headlines as H
from marketlens.operators import attribution, rules, series, sets, views
from marketlens.plans import catalogue
from marketlens.plans.catalogue import _GRAHAM, _RANK, _SHARE, _WARN, HOLDINGS, METRICS, QUARTERS, VALUED, query
from marketlens.sources.tables import holdings, metrics, sales_series, table

_KEY = "CAST(s_suppkey AS STRING)"
_SHORT = f"CASE s_suppkey % 3 WHEN 0 THEN 'Alpha' || {_KEY} || ' Industries' WHEN 1 THEN 'Beta' || {_KEY} ELSE 'Gamma & Sons' || {_KEY} END"
_NAME = f"CASE s_suppkey % 3 WHEN 2 THEN 'Gamma & Sons' || {_KEY} || ' (GS' || {_KEY} || ')' ELSE {_SHORT} END"
_PAID = "CAST(floor(o_totalprice) AS BIGINT)"
#: one term of every vocabulary, and some that are in none
_TERMS = ("smartphone", "systems", "CCTV", "solar module", "wafer", "data centre", "UAV", "garment manufacturing", "athleisure", "steel", "rice")
_TERM = f"CASE o_orderkey % 11 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TERMS))} END"
_DAY = "CAST(DATE '1998-01-01' + CAST(o_orderkey * 7 % 181 AS INT) AS DATE)"
_TITLE = f"""CASE o_orderkey % 12 WHEN 0 THEN short || ' wins order worth Rs ' || CAST({_PAID} AS STRING) || ' crore from exporters' WHEN 1 THEN 'CEO ' || short || ' said demand is strong'
WHEN 2 THEN short || ' Hotels to acquire rival; ' || short || ' plans more' WHEN 3 THEN short || ' signs MoU with T' || CAST(s_suppkey % 10 + 1 AS STRING) || ' for $' || CAST({_PAID} % 900 + 1 AS STRING) || ' million'
WHEN 4 THEN 'Movers: ' || short || ', T' || CAST(s_suppkey % 7 + 1 AS STRING) || ' stocks rally 5%' WHEN 5 THEN short || ' denies merger with rival — ' || short || ' bags contract for 500 MW'
WHEN 6 THEN short || ' commissions line of 2 lakh tonnes, reportedly' WHEN 7 THEN 'Copper shortage hits ' || short || ' and ' || {_TERM} || ' makers | shares slip' WHEN 8 THEN short || '''s profit rises on record revenue'
WHEN 9 THEN 'T' || {_KEY} || ' partners with Beta' || CAST(s_suppkey % 9 * 3 + 1 AS STRING) WHEN 10 THEN lower(short) || ' opens Q1 with raw material cost up on ' || {_TERM} ELSE 'Nothing of note today' END"""
_ISSUED = f"co AS (SELECT 'T' || {_KEY} AS ticker, {_NAME} AS name, {_SHORT} AS short, s_suppkey, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey), hl AS (SELECT o_orderkey AS id, {_DAY} AS day, sector, {_TITLE} AS title, {_PAID} AS paid FROM orders JOIN co ON s_suppkey = o_custkey)"
_CLEAN = "list_transform({}, lambda x: regexp_replace(regexp_replace(lower(x), '\\.+$', ''), '''s$', ''))"
_TOKENS = "regexp_extract_all({}, '[A-Za-z0-9&.'']+')"
_IN = lambda words: ", ".join(repr(w) for w in words)


def _match_sql(source: str, made: str) -> str:
    """CTEs that end in ``made``(id, ticker): which texts of source(id, title) name which companies."""
    return f"""{made}_own AS (SELECT ticker, {_CLEAN.format(_TOKENS.format("name"))} AS own, split_part(name, '(', 1) AS core, regexp_extract_all(name, '\\(([^)]+)\\)', 1) AS alias FROM co),
{made}_ph AS (SELECT ticker, own, {_CLEAN.format(_TOKENS.format("core"))} AS w FROM {made}_own UNION SELECT ticker, own, [lower(ticker)] FROM {made}_own UNION SELECT ticker, own, {_CLEAN.format(_TOKENS.format("a"))} FROM (SELECT ticker, own, unnest(alias) AS a FROM {made}_own)),
{made}_tk AS (SELECT id, {_TOKENS.format("title")} AS t, string_split_regex(title, '[A-Za-z0-9&.'']+') AS gaps FROM {source}), {made}_cl AS (SELECT *, {_CLEAN.format("t")} AS c FROM {made}_tk), {made}_w AS (SELECT *, unnest(range(1, len(c) + 1)) AS p FROM {made}_cl),
{made} AS (SELECT DISTINCT id, ticker FROM {made}_w JOIN {made}_ph ON c[p] = w[1] AND c[p:p + len(w) - 1] = w WHERE len(w) > 1 OR NOT ((p > 1 AND c[p - 1] IN ({_IN(H.PERSON_TITLES)})) OR coalesce(p < len(c) AND trim(gaps[p + 1]) = '' AND regexp_matches(t[p + 1], '^[A-Z]')
  AND NOT (c[p + 1] IN ({_IN([*H.CORPORATE, *H.HEADLINE_VERBS, *H.FUNCTION_WORDS])}) OR list_contains(own, c[p + 1]) OR regexp_matches(c[p + 1], '{H.PERIOD}')), false)))"""


_EVENT = "CASE WHEN regexp_matches(lower(clause), '{}') THEN NULL {} END".format(H.any_of(H.NEGATIONS), "{}")
_KIND = _EVENT.format(" ".join(f"WHEN contains(lower(clause), '{p}') THEN '{kind}'" for kind, ps in H.EVENTS.items() for p in ps))
_PHRASE = _EVENT.format(" ".join(f"WHEN contains(lower(clause), '{p}') THEN '{p}'" for ps in H.EVENTS.values() for p in ps))
_EVENTS = f"""cs AS (SELECT id, unnest(list_filter(list_transform(string_split_regex(title, '\\s*[;–—]\\s*|\\s+-\\s+|\\s*\\|\\s*'), lambda x: trim(x)), lambda x: x <> '')) AS clause, generate_subscripts(list_filter(list_transform(string_split_regex(title, '\\s*[;–—]\\s*|\\s+-\\s+|\\s*\\|\\s*'), lambda x: trim(x)), lambda x: x <> ''), 1) AS k FROM hl),
ty AS (SELECT *, {_KIND} AS type, {_PHRASE} AS phrase FROM cs), fe AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM ty WHERE type IS NOT NULL),
ev AS (SELECT id, type, phrase, clause, CASE WHEN regexp_matches(lower(clause), '{H.any_of(H.REPORTED)}') THEN 'reported' WHEN regexp_matches(lower(clause), '{H.any_of(H.ANNOUNCED)}') THEN 'announced' ELSE 'completed' END AS certainty,
  CASE WHEN type IN ('supply_disruption', 'input_cost_shock') THEN 'risk' ELSE 'opportunity' END AS direction FROM fe WHERE n = 1)"""
_MATCHED = f"WITH {_ISSUED}, {_match_sql('hl', 'mt')}"
_COVERED = f"""{_MATCHED}, ck AS (SELECT ticker, hl.*, trim(regexp_replace(lower(title), '[^a-z0-9 ]+', '', 'g')) AS k, date_diff('day', day, (SELECT max(day) FROM hl)) > 120 AS old FROM hl JOIN mt ON hl.id = mt.id),
cv AS (SELECT ticker, id, CASE WHEN id > min(id) FILTER (WHERE NOT old) OVER (PARTITION BY ticker, k) THEN 'merged' WHEN old THEN 'excluded' ELSE 'counted' END AS status FROM ck WHERE k <> '')"""


def _companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.expr(f"'T' || {_KEY}").alias("ticker"), F.expr(_NAME).alias("name"), F.expr(_SHORT).alias("short"), "s_suppkey", F.col("n_name").alias("sector"))


def _headlines(spark: SparkSession, d: str) -> DataFrame:
    # orders are many, and would be broadcast where few of their columns are read
    rows = table(spark, d, "orders").hint("merge").join(_companies(spark, d), F.col("s_suppkey") == F.col("o_custkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.expr("date_add(DATE'1998-01-01', cast(o_orderkey * 7 % 181 as int))").alias("day"), "sector", F.expr(_TITLE).alias("title"))


def _today(titles: DataFrame) -> DataFrame:
    return titles.agg(F.max("day").alias("today"))


@query(f"{_MATCHED} SELECT id, ticker FROM mt")
def company_matches(spark: SparkSession, d: str) -> DataFrame:
    return attribution.named(_headlines(spark, d), _companies(spark, d))


# each vocabulary is that of the nations whose key leaves its number
_TURF = "tf AS (SELECT n_name AS sector, term FROM nation JOIN (VALUES {}) v(k, term) ON n_nationkey % {} = k)".format(", ".join(f"({k}, '{t}')" for k, ts in enumerate(H.BATTLEGROUNDS.values()) for t in ts), len(H.BATTLEGROUNDS))
_DOMAINS = f"{_TURF}, dm AS (SELECT id, string_agg(sector, '; ' ORDER BY sector) AS domains FROM (SELECT DISTINCT hl.id, tf.sector FROM hl JOIN tf ON contains(lower(title), term)) GROUP BY 1)"


def _turf(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([(k, t) for k, ts in enumerate(H.BATTLEGROUNDS.values()) for t in ts], "k long, term string")
    return table(spark, d, "nation").join(terms, F.col("n_nationkey") % len(H.BATTLEGROUNDS) == F.col("k")).select(F.col("n_name").alias("sector"), "term")


def _market_events(spark: SparkSession, d: str) -> DataFrame:
    return attribution.market_events(_headlines(spark, d), _turf(spark, d), _companies(spark, d))


@query(f"WITH {_ISSUED}, {_EVENTS}, {_DOMAINS} SELECT ev.*, coalesce(domains, '') AS domains FROM ev LEFT JOIN dm ON ev.id = dm.id")
def headline_events(spark: SparkSession, d: str) -> DataFrame:
    found = attribution.events(_headlines(spark, d))
    both = found.join(attribution.domains(found, _turf(spark, d)), "id", "left")
    return both.select("id", "type", "phrase", "clause", "certainty", "direction", F.coalesce(F.array_join("domains", "; "), F.lit("")).alias("domains"))


_ACTED = f"WITH {_ISSUED}, {_EVENTS}, ec AS (SELECT id, clause AS title FROM ev), {_match_sql('ec', 'ac')}"
_TRACKED = f"{_ACTED}, {_DOMAINS}, ag AS (SELECT id, string_agg(ticker, '; ' ORDER BY ticker) AS actors FROM ac GROUP BY 1), me AS (SELECT ev.*, hl.day, hl.title, coalesce(domains, '') AS domains, coalesce(actors, '') AS actors FROM ev JOIN hl ON ev.id = hl.id LEFT JOIN dm ON ev.id = dm.id LEFT JOIN ag ON ev.id = ag.id WHERE domains IS NOT NULL OR actors IS NOT NULL)"


def _lists(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.array_join(c, "; ") for c in ("domains", "actors")})


@query(f"{_TRACKED} SELECT id, day, title, type, phrase, certainty, direction, domains, actors FROM me")
def market_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that touch a sector's vocabulary or name a company in their own clause."""
    return _lists(_market_events(spark, d)).select("id", "day", "title", "type", "phrase", "certainty", "direction", "domains", "actors")


# the corpus of an earlier run: attributed when only every second company was followed; every seventh row lacks its certainty
_CORPUS = f"{_TRACKED}, rc AS (SELECT me.* REPLACE (coalesce(nullif(CASE WHEN me.id % 7 = 0 THEN '' ELSE certainty END, ''), certainty) AS certainty) FROM me WHERE day >= (SELECT max(day) FROM hl) - 45)"


@query(f"{_CORPUS} SELECT id, day, certainty, domains, actors FROM rc WHERE domains <> '' OR id IN (SELECT id FROM ac WHERE CAST(ticker[2:] AS INT) % 2 = 0)")
def refreshed_events(spark: SparkSession, d: str) -> DataFrame:
    """The corpus of a run that followed every second company, by the companies of now: what names none of either is not in it."""
    companies, titles = _companies(spark, d), _headlines(spark, d)
    corpus = attribution.market_events(titles, _turf(spark, d), companies.where("s_suppkey % 2 = 0"))
    corpus = corpus.withColumn("certainty", F.when(F.col("id") % 7 != 0, F.col("certainty"))).select("id", "title", "day", "type", "phrase", "certainty", "direction", "domains", "actors")
    return _lists(attribution.refreshed(corpus, companies, _today(titles).scalar())).select("id", "day", "certainty", "domains", "actors")


@query(f"{_ACTED} SELECT ev.id, ticker, type, certainty, direction, 'Low' AS severity, 'Corporate Move' AS category FROM ev JOIN ac ON ev.id = ac.id")
def event_actors(spark: SparkSession, d: str) -> DataFrame:
    """A warning for each company that an event's own clause names."""
    found = attribution.events(_headlines(spark, d))
    actors = attribution.named(found.select("id", F.col("clause").alias("title")), _companies(spark, d))
    return found.join(actors, "id").select("id", "ticker", "type", "certainty", "direction", F.lit("Low").alias("severity"), F.lit("Corporate Move").alias("category"))


# edges: what an anchor company or an input feeds, made up from company numbers
_EDGES = "ed AS (SELECT short AS src, CASE WHEN s_suppkey % 2 = 0 THEN 'T' || CAST(s_suppkey AS STRING) ELSE sector END AS dst, CASE WHEN s_suppkey % 3 = 1 THEN 'anchor_demand' ELSE 'partner' END AS type FROM co WHERE s_suppkey <= 60)"
_TOUCHED = f"""WITH {_ISSUED}, {_EVENTS}, co0 AS (SELECT * FROM co), {_EDGES}, sq AS (SELECT DISTINCT src FROM ed), {_match_sql('hl', 'nm').replace('FROM co)', 'FROM (SELECT src AS ticker, src AS name FROM sq))', 1)},
tp AS (SELECT sector, ticker, row_number() OVER (PARTITION BY sector ORDER BY s_suppkey) AS n FROM co)"""


@query(f"""{_TOUCHED}, he AS (SELECT DISTINCT ev.id, direction, src, dst FROM ev JOIN nm ON ev.id = nm.id JOIN ed ON ed.src = nm.ticker)
SELECT he.id, src, coalesce(co.ticker, tp.ticker) AS ticker, direction, 'Low' AS severity, 'Ecosystem Signal' AS category FROM he LEFT JOIN co ON he.dst = co.ticker LEFT JOIN tp ON co.ticker IS NULL AND he.dst = tp.sector AND tp.n <= 3 WHERE coalesce(co.ticker, tp.ticker) IS NOT NULL""")
def ecosystem_signals(spark: SparkSession, d: str) -> DataFrame:
    """Events that reach a company along an edge: one whose source the headline names."""
    companies = _companies(spark, d)
    edges = companies.where("s_suppkey <= 60").select(F.col("short").alias("src"), F.when(F.col("s_suppkey") % 2 == 0, F.col("ticker")).otherwise(F.col("sector")).alias("dst"), F.when(F.col("s_suppkey") % 3 == 1, "anchor_demand").otherwise("partner").alias("type"))
    titles = _headlines(spark, d)
    return attribution.along_edges(attribution.events(titles), titles, edges, companies.select("ticker", "sector", F.col("s_suppkey").alias("ord")))


@query(f"""{_TRACKED}, c3 AS (SELECT DISTINCT me.id, tf.sector FROM me JOIN tf ON contains(lower(title), term) WHERE direction = 'risk'), c4 AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY id) AS n FROM c3)
SELECT c4.id, ticker, c4.sector, 'Medium' AS severity, 'risk' AS direction, 'Supply Chain' AS category FROM c4 JOIN co ON c4.sector = co.sector WHERE n <= 3""")
def supply_chain_signals(spark: SparkSession, d: str) -> DataFrame:
    """The first three risk events that touch a sector's vocabulary reach all of its companies."""
    return attribution.supply_chain(_market_events(spark, d), _companies(spark, d))


_STRESS = f"""{_TRACKED}, rk AS (SELECT id, title FROM me WHERE direction = 'risk' AND certainty <> 'reported' AND day >= (SELECT max(day) FROM hl) - 14),
ie AS (SELECT 'copper' AS src, n_name AS dst FROM nation WHERE n_nationkey % 5 = 0), ss AS (SELECT rk.id, tf.sector FROM rk JOIN tf ON contains(lower(title), term) UNION SELECT id, dst FROM rk JOIN ie ON contains(lower(title), src)), st AS (SELECT sector, count(*) AS n, count(*) >= 2 AS warns FROM ss GROUP BY 1)"""


@query(f"{_STRESS} SELECT * FROM st")
def supply_stress_sectors(spark: SparkSession, d: str) -> DataFrame:
    """Settled risk events of the last 14 days a sector, by its vocabulary or through an input that it depends on."""
    inputs = table(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.lit("Copper").alias("src"), F.col("n_name").alias("dst"))
    return attribution.sector_stress(_market_events(spark, d), inputs, _today(_headlines(spark, d)).scalar())


@query(f"{_STRESS} SELECT ticker, st.sector, 'Medium' AS severity, 'risk' AS direction, 'Supply Stress (Forward)' AS category, n FROM st JOIN co ON st.sector = co.sector WHERE warns")
def supply_stress_warnings(spark: SparkSession, d: str) -> DataFrame:
    return attribution.stress_warnings(supply_stress_sectors(spark, d), _companies(spark, d))


@query(f"WITH {_ISSUED}, {_EVENTS} SELECT type, certainty, count(*) AS n FROM ev GROUP BY 1, 2")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return attribution.events(_headlines(spark, d)).groupBy("type", "certainty").agg(F.count("*").alias("n"))


@query(f"{_COVERED} SELECT * FROM cv")
def coverage_items(spark: SparkSession, d: str) -> DataFrame:
    titles = _headlines(spark, d)
    return attribution.coverage(titles, company_matches(spark, d), _today(titles))


@query(f"{_COVERED} SELECT ticker, count(*) AS items, count(*) FILTER (WHERE status = 'counted') AS counted, count(*) FILTER (WHERE status = 'merged') AS merged FROM cv GROUP BY 1")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    status = lambda x: F.count_if(F.col("status") == x).alias(x)
    return coverage_items(spark, d).groupBy("ticker").agg(F.count("*").alias("items"), status("counted"), status("merged"))


@query(f"{_MATCHED}, f AS (SELECT ticker, min(hl.id) AS id FROM hl JOIN mt ON hl.id = mt.id GROUP BY ticker, lower(trim(title))) SELECT ticker, id, row_number() OVER (PARTITION BY ticker ORDER BY id) AS place FROM f QUALIFY place <= 8")
def stock_topics(spark: SparkSession, d: str) -> DataFrame:
    return attribution.topics(_headlines(spark, d), company_matches(spark, d))


@query(f"""{_MATCHED} SELECT a.ticker AS src, b.ticker AS dst, min(hl.id) AS evidence FROM hl JOIN mt a ON hl.id = a.id JOIN mt b ON hl.id = b.id AND a.ticker < b.ticker
WHERE {' OR '.join(f"contains(lower(title), '{p}')" for p in H.EVENTS['tie_up'])} GROUP BY 1, 2""")
def partner_edges(spark: SparkSession, d: str) -> DataFrame:
    return attribution.partner_edges(_headlines(spark, d), company_matches(spark, d))


# the oracle reads no amount from a headline: it knows which shapes were given one
_SIZED = f"""{_MATCHED}, rv AS (SELECT 'T' || CAST(ticker AS VARCHAR) AS ticker, CAST(sum(CAST(sales AS DECIMAL(18,2))) AS DOUBLE) / 1e3 AS revenue, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS back FROM ({QUARTERS})) WHERE back <= 4 GROUP BY 1),
am AS (SELECT hl.id, mt.ticker, CASE id % 12 WHEN 0 THEN paid * 1.0 WHEN 3 THEN (paid % 900 + 1) * 0.1 * 83.0 END AS amount, hl.id % 12 IN (0, 3, 5, 2) AS sized FROM hl JOIN mt USING (id)),
mv AS (SELECT id, am.ticker, CAST(amount AS DOUBLE) AS amount_cr, sized, CAST(amount AS DOUBLE) / revenue * 100 AS pct FROM am LEFT JOIN rv ON am.ticker = rv.ticker AND n = 4 AND revenue > 0),
mb AS (SELECT *, CASE WHEN NOT sized OR pct IS NULL THEN 'unknown' WHEN pct >= 15 THEN 'transformative' WHEN pct >= 5 THEN 'material' WHEN pct >= 2 THEN 'minor' ELSE 'immaterial' END AS band FROM mv)"""


def _revenue(spark: SparkSession, d: str) -> DataFrame:
    """ticker, revenue: the sales of a company's last four quarters, of those that have four."""
    newest = series.from_end(sales_series(spark, d), ["ticker"], "period").where("back <= 4").groupBy("ticker").agg(F.sum(F.col("sales").cast("decimal(18,2)")).cast("double").alias("year"), F.count("*").alias("n")).where("n = 4 and year > 0")
    return newest.select(F.concat(F.lit("T"), F.col("ticker").cast("string")).alias("ticker"), (F.col("year") / 1e3).alias("revenue"))


@query(f"{_SIZED} SELECT id, ticker, round(amount_cr, 4) AS amount_cr, round(pct, 2) AS pct_of_revenue, band, CAST(CASE band WHEN 'transformative' THEN 1.5 WHEN 'minor' THEN 0.5 WHEN 'immaterial' THEN 0.25 ELSE 1.0 END AS DOUBLE) AS weight FROM mb")
def order_materiality(spark: SparkSession, d: str) -> DataFrame:
    told = attribution.with_event(_headlines(spark, d)).select("id", "title", "type").join(company_matches(spark, d), "id")
    return attribution.materiality(told, _revenue(spark, d)).withColumn("amount_cr", F.round("amount_cr", 4)).withColumn("weight", F.col("weight").cast("double"))


@query(f"""WITH h AS ({HOLDINGS}), q AS ({QUARTERS}), r AS (SELECT q.*, sector, region, row_number() OVER (PARTITION BY q.ticker ORDER BY period DESC) AS back FROM q JOIN h ON q.ticker = h.ticker),
n AS (SELECT ticker, sector, region, max(sales) FILTER (WHERE back = 1) AS now, max(sales) FILTER (WHERE back = 2) AS was FROM r GROUP BY 1, 2, 3),
s AS (SELECT *, round(now / CAST(sum(CAST(now AS DECIMAL(18,2))) OVER (PARTITION BY region) AS DOUBLE) * 100, 2) AS share_pct, round(was / CAST(sum(CAST(was AS DECIMAL(18,2))) OVER (PARTITION BY region) AS DOUBLE) * 100, 2) AS prior, count(*) OVER (PARTITION BY region) AS peer_count FROM n WHERE now > 0)
SELECT ticker, sector, share_pct, CASE WHEN ticker % 5 <> 0 THEN round(share_pct - prior, 2) END AS change_pp, peer_count FROM s WHERE peer_count >= 2 AND ticker % 3 = 0""")
def industry_share(spark: SparkSession, d: str) -> DataFrame:
    """Held companies' shares of their whole industry: regions stand for industries, every third company is held."""
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("sales")))
    newest = series.from_end(sales_series(spark, d), ["ticker"], "period").where("back <= 2").groupBy("ticker").agg(at(1).alias("now"), at(2).alias("was"))
    rows = newest.join(holdings(spark, d), "ticker").select("ticker", "sector", F.col("region").alias("industry"), "now", "was")
    held = rows.where("ticker % 3 = 0").select("ticker", "sector", "industry")
    prior = series.industry_share(rows.select("ticker", "industry", F.col("was").alias("sales")), held).where("ticker % 5 <> 0").select("ticker", F.col("share_pct").alias("prior"))
    now = series.industry_share(rows.select("ticker", "industry", F.col("now").alias("sales")), held)
    return now.join(prior, "ticker", "left").select("ticker", "sector", "share_pct", F.round(F.col("share_pct") - F.col("prior"), 2).alias("change_pp"), "peer_count")


_MOVES = """p AS (SELECT p_brand AS input, l_shipdate AS ts, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS close FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
c AS (SELECT input, count(*) AS sessions, arg_min(close, (ts, l_orderkey, l_linenumber)) AS f, arg_max(close, (ts, l_orderkey, l_linenumber)) AS l FROM p GROUP BY 1),
mo AS (SELECT input, CASE WHEN f <> 0 THEN (l - f) / abs(f) * 100 END AS pct FROM c WHERE sessions >= 2),
ex AS (SELECT b.input, n_name AS sector, (n_nationkey % 4 + 1) / 10.0 AS weight, CASE WHEN (n_nationkey + CAST(regexp_extract(b.input, '[0-9]+') AS INT)) % 3 = 0 THEN 'producer' ELSE 'consumer' END AS side FROM (SELECT DISTINCT p_brand AS input FROM part) b JOIN nation ON (CAST(regexp_extract(b.input, '[0-9]+') AS INT) + n_nationkey) % 6 = 0)"""


@query(f"""WITH {_MOVES}, pr AS (SELECT sector, mo.input, pct, CAST(weight AS DOUBLE) AS weight, CASE WHEN side = 'consumer' THEN pct ELSE -pct END AS pressure FROM mo JOIN ex ON mo.input = ex.input WHERE abs(pct) >= 5),
s AS (SELECT sector, round(sum(CAST(pressure * weight AS DECIMAL(28,10))), 2) AS score, count(*) AS n_drivers, arg_max(input, (abs(pct * weight), input)) AS top_driver FROM pr GROUP BY 1)
SELECT sector, CAST(score AS DOUBLE) AS score, n_drivers, top_driver, CASE WHEN abs(score) >= 12 THEN 'severe' WHEN abs(score) >= 5 THEN 'material' ELSE 'quiet' END AS band, CASE WHEN score > 0 THEN 'cost pressure' ELSE 'tailwind' END AS direction FROM s""")
def input_cost_shock(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_quantity > 0").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("close", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    moves = rows.groupBy(F.col("p_brand").alias("input")).agg(F.count("*").alias("sessions"), F.min_by("close", order).alias("f"), F.max_by("close", order).alias("l")).where("sessions >= 2").select("input", coerce.change(F.col("f"), F.col("l")).alias("pct"))
    inputs = table(spark, d, "part").select(F.col("p_brand").alias("input"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("no")).distinct()
    # a small dimension: which sectors use or sell an input, made up from their numbers
    exposure = table(spark, d, "nation").join(inputs, F.expr("(no + n_nationkey) % 6 = 0")).select("input", F.col("n_name").alias("sector"), ((F.col("n_nationkey") % 4 + 1) / 10.0).alias("weight"), F.when((F.col("n_nationkey") + F.col("no")) % 3 == 0, "producer").otherwise("consumer").alias("side"))
    return series.input_cost_shock(moves, exposure)


_EVERY = f"""m AS ({METRICS}), w0 AS ({_WARN}),
sh AS (SELECT ticker, sector, category, direction, severity FROM ({catalogue.SQL['share_warnings']})),
ct AS (SELECT ticker, sector, category, direction, severity FROM ({catalogue.SQL['competitive_threats']})), pl AS (SELECT m.ticker, sector, 'Promoter Pledging' AS category, 'risk' AS direction, severity FROM ({catalogue.SQL['pledge_verdict']}) v JOIN m ON v.ticker = m.ticker WHERE severity IS NOT NULL),
vs AS (SELECT m.ticker, sector, 'Valuation Stretch' AS category, 'risk' AS direction, 'Medium' AS severity FROM ({catalogue.SQL['valuation_alerts']}) v JOIN m ON v.ticker = m.ticker WHERE alerts <> ''),
gl AS (SELECT ticker, sector, category, direction, severity FROM ({catalogue.SQL['growth_laggard_warnings']})),
aw AS (SELECT * FROM w0 UNION ALL SELECT * FROM sh UNION ALL SELECT * FROM ct UNION ALL SELECT * FROM pl UNION ALL SELECT * FROM vs UNION ALL SELECT * FROM gl)"""


def _all_warnings(spark: SparkSession, d: str) -> DataFrame:
    companies = rules.valuation_alerts_of(rules.graham(catalogue._valued(spark, d)))
    columns = ["ticker", "sector", "category", "direction", "severity"]
    # the verdict and the other rules read one row of a company
    pledged = rules.pledge_verdict(metrics(spark, d)).where("severity is not null").join(holdings(spark, d).select("ticker", "sector"), "ticker").select("ticker", "sector", F.lit("Promoter Pledging").alias("category"), F.lit("risk").alias("direction"), "severity")
    found = rules.warnings(companies).select(columns)
    for more in (catalogue.share_warnings(spark, d), catalogue.competitive_threats(spark, d), pledged, catalogue.growth_laggard_warnings(spark, d)):
        found = found.unionByName(more.select(columns))
    return found


def _with_sector(spark: SparkSession, d: str) -> DataFrame:
    return sales_series(spark, d).join(holdings(spark, d).select("ticker", "sector"), "ticker")


_BOOK = ", ".join(f"('{c}', '{sure}', '{source}')" for c, sure, source in rules.RULE_BOOK)


@query(f"""WITH {_EVERY}, bk(category, confidence, evidence_source) AS (VALUES {_BOOK}) SELECT ticker, sector, aw.category, direction, severity, coalesce(confidence, 'Medium') AS confidence, coalesce(evidence_source, 'Mixed') AS evidence_source FROM aw LEFT JOIN bk ON aw.category = bk.category""")
def early_warnings(spark: SparkSession, d: str) -> DataFrame:
    """All warnings with their rule book entries, in the order of the briefing."""
    return rules.in_order(rules.with_rules(_all_warnings(spark, d)))


@query(f"""WITH {_EVERY}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY {_RANK.format('severity')}, category) AS n, count(*) OVER (PARTITION BY ticker) AS warnings FROM aw WHERE direction = 'risk')
SELECT sector, ticker, severity, category, warnings, row_number() OVER (PARTITION BY sector ORDER BY {_RANK.format('severity')}, warnings DESC, ticker) AS rank FROM o WHERE n = 1 QUALIFY rank <= 3""")
def sector_focus(spark: SparkSession, d: str) -> DataFrame:
    """Of each sector the three companies with the gravest risks: the gravest severity, its first category, how many."""
    risk = _all_warnings(spark, d).where("direction = 'risk'").withColumn("grave", coerce.severity_rank(F.col("severity")))
    one = risk.groupBy("sector", "ticker").agg(F.min(F.struct("grave", "category", "severity")).alias("w"), F.count("*").alias("warnings"))
    return sets.top_of(one.select("sector", "ticker", "w.severity", "w.category", "warnings", "w.grave"), ["sector"], [F.col("grave"), F.desc("warnings"), F.col("ticker")], 3).drop("grave")


_SCORED = f"""{VALUED}, x AS (SELECT *, {_GRAHAM} AS g, CASE WHEN value > 0 THEN CASE WHEN roce > 15 THEN 1 ELSE 0 END + CASE WHEN roe > 15 THEN 1 ELSE 0 END + CASE WHEN debt / (0.5 * value) < 0.5 THEN 1 ELSE 0 END END AS moat FROM m),
f AS (SELECT ticker, CASE WHEN ttm >= 15 THEN 1 WHEN ttm < 0 THEN -2 ELSE 0 END + CASE WHEN opm_change >= 2 THEN 1 WHEN opm_change <= -2 THEN -1 ELSE 0 END + CASE WHEN debt_equity < 0.5 THEN 1 WHEN debt_equity > 1 THEN -2 ELSE 0 END
 + CASE WHEN current_ratio >= 2 THEN 1 WHEN current_ratio < 1 THEN -1 ELSE 0 END + CASE WHEN roce >= 20 THEN 1 ELSE 0 END + CASE WHEN roe >= 15 THEN 1 ELSE 0 END + CASE WHEN promoter_change <= -1 THEN -2 ELSE 0 END
 + CASE WHEN fii_change > 0 THEN 2 WHEN fii_change < -1 THEN -1 ELSE 0 END + CASE WHEN dii_change > 0 THEN 1 ELSE 0 END + CASE moat WHEN 3 THEN 3 WHEN 2 THEN 1 ELSE 0 END
 + CASE WHEN price < net_assets / (CASE WHEN price > 0 THEN value / price ELSE 1.0 END) THEN 3 WHEN g <> 0 AND price <> 0 AND price < g THEN 2 ELSE 0 END
 - 2 * (CASE WHEN current_ratio < 2 THEN 1 ELSE 0 END + CASE WHEN debt > net_assets THEN 1 ELSE 0 END + CASE WHEN pe > 15 AND NOT price <= g * 1.2 THEN 1 ELSE 0 END + CASE WHEN pe > 30 AND (revenue_last < revenue_before OR coalesce(qoq < 15, false)) THEN 1 ELSE 0 END) AS fundamental_score FROM x WHERE value > 0)"""


# the kinds of news that name a company, by the headline's number
_KINDS = ("Agreement", "tie_up", "Launch", "MoU", "PLI")
_KIND_OF = f"CASE {{}} % 5 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END"
_NEWS = f"""{_SIZED}, nk AS (SELECT mt.ticker, hl.id, hl.day, hl.title, {_KIND_OF.format('hl.id')} AS kind, trim(regexp_replace(lower(title), '[^a-z0-9 ]+', '', 'g')) AS k, mv.pct AS pct,
  hl.id % 12 = 0 OR (hl.id % 12 = 3 AND hl.id % 5 IN (0, 1)) AS sized FROM hl JOIN mt ON hl.id = mt.id JOIN mv ON mv.id = hl.id AND mv.ticker = mt.ticker),
n1 AS (SELECT * FROM nk QUALIFY row_number() OVER (PARTITION BY ticker, k ORDER BY id) = 1),
n2 AS (SELECT ticker, id, CASE kind WHEN 'PLI' THEN 5 WHEN 'Agreement' THEN 4 WHEN 'MoU' THEN 4 WHEN 'Launch' THEN 3 ELSE 4 END * CASE WHEN NOT sized OR pct IS NULL THEN 1.0 WHEN pct >= 15 THEN 1.5 WHEN pct >= 5 THEN 1.0 WHEN pct >= 2 THEN 0.5 ELSE 0.25 END AS gain FROM n1 WHERE date_diff('day', day, (SELECT max(day) FROM hl)) <= 120),
n3 AS (SELECT *, coalesce(sum(gain) OVER (PARTITION BY ticker ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM n2),
np AS (SELECT ticker, count(*) AS n_counted, CAST(round_even(CAST(least(sum(gain), 8) AS DOUBLE), 0) AS INT) AS momentum FROM n3 WHERE bef < 8 GROUP BY 1)"""


@query(f"{_NEWS} SELECT ticker, n_counted, momentum FROM np")
def news_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the news that name a company: each kind's, by size against revenue, up to the cap."""
    titles = _headlines(spark, d)
    told = titles.join(company_matches(spark, d), "id").withColumn("type", F.expr(_KIND_OF.format("id")))
    weight = attribution.materiality(told.select("id", "ticker", "type", "title"), _revenue(spark, d)).select("id", "ticker", "weight")
    events = told.join(weight, ["id", "ticker"]).select("ticker", F.col("id").alias("place"), "title", "type", "day", "weight")
    return rules.news_points(events, _today(titles).scalar())


_SCORE = f"""{_SCORED.replace('AS fundamental_score', f"""- CASE liquidity_band WHEN 'illiquid' THEN 2 WHEN 'thin' THEN 1 ELSE 0 END AS fundamental_score, coalesce(momentum, 1) AS momentum_score,
  CASE WHEN 2 + CASE WHEN revenue_last IS NULL THEN 0 ELSE 1 END + CASE WHEN debt_equity IS NULL THEN 0 ELSE 1 END + CASE WHEN ttm IS NULL THEN 0 ELSE 1 END + CASE WHEN roce IS NULL THEN 0 ELSE 1 END >= 5 THEN 'High' ELSE 'Medium' END AS confidence,
  CASE WHEN ttm >= 15 THEN 1 ELSE 0 END + CASE WHEN opm_change >= 2 THEN 1 ELSE 0 END + CASE WHEN debt_equity < 0.5 THEN 1 ELSE 0 END + CASE WHEN current_ratio >= 2 THEN 1 ELSE 0 END + CASE WHEN roce >= 20 THEN 1 ELSE 0 END + CASE WHEN roe >= 15 THEN 1 ELSE 0 END + CASE WHEN liquidity_band = 'liquid' THEN 1 ELSE 0 END + CASE WHEN fii_change > 0 THEN 1 ELSE 0 END
  + CASE WHEN dii_change > 0 THEN 1 ELSE 0 END + CASE WHEN moat >= 2 THEN 1 ELSE 0 END + CASE WHEN price < net_assets / (CASE WHEN price > 0 THEN value / price ELSE 1.0 END) OR (g <> 0 AND price <> 0 AND price < g) THEN 1 ELSE 0 END AS n_reasons""")}"""
_SCORE = _SCORE.replace("FROM x WHERE value > 0)", f"FROM x LEFT JOIN (SELECT part, liquidity_band FROM ({catalogue.SQL['traded_value']})) tv ON part = x.ticker LEFT JOIN ({_NEWS} SELECT ticker AS named, momentum FROM np) nw ON named = 'T' || CAST(x.ticker AS VARCHAR) WHERE value > 0)")


@query(f"""{_SCORE} SELECT ticker, CAST(fundamental_score AS INT) AS fundamental_score, CAST(momentum_score AS INT) AS momentum_score, CAST(fundamental_score + momentum_score AS INT) AS overall_score, confidence, CAST(n_reasons AS INT) AS n_reasons,
CASE WHEN fundamental_score + momentum_score >= 15 THEN 'Strong Buy Candidate' WHEN fundamental_score + momentum_score >= 10 THEN 'Buy Candidate' WHEN fundamental_score + momentum_score >= 5 THEN 'Hold / Monitor' ELSE 'Avoid / High Risk' END AS recommendation FROM f""")
def aggregate_score(spark: SparkSession, d: str) -> DataFrame:
    """Whole-company scores, with the points of news and the liquidity of the shares (a part stands for a share)."""
    traded = catalogue.traded_value(spark, d).select(F.col("part").alias("ticker"), "liquidity_band", "advt_cr", "days_to_exit_1cr")
    news = news_points(spark, d).select(F.expr("cast(substring(ticker, 2) as bigint)").alias("ticker"), "momentum")
    rows = catalogue._valued(spark, d).where("value > 0").join(traded, "ticker", "left").join(news, "ticker", "left")
    return rules.aggregate_score(rows).select("ticker", "fundamental_score", "momentum_score", "overall_score", "confidence", F.size("reasons").alias("n_reasons"), "recommendation")


@query(f"WITH v AS ({catalogue.SQL['traded_value']}) SELECT liquidity_band, count(*) AS n, round(min(advt_cr), 2) AS least, round(max(advt_cr), 2) AS most FROM v GROUP BY 1")
def liquidity_coverage(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.traded_value(spark, d).groupBy("liquidity_band").agg(F.count("*").alias("n"), F.round(F.min("advt_cr"), 2).alias("least"), F.round(F.max("advt_cr"), 2).alias("most"))


@query(f"WITH p AS ({catalogue.SQL['potential_estimate']}) SELECT sector, method, count(*) AS n, round(avg(coalesce(potential, 0)), 4) AS average FROM p GROUP BY 1, 2")
def average_potential(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.potential_estimate(spark, d).groupBy("sector", "method").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("potential", F.lit(0.0))), 4).alias("average"))


@query(f"""WITH {_ISSUED}, i AS (SELECT *, CASE WHEN id % 12 IN (0, 5, 6) THEN 'Positive' WHEN id % 12 IN (7, 10) THEN 'Negative' ELSE 'Neutral' END AS impact FROM hl), f AS (SELECT sector, lower(title) AS k, arg_min(impact, id) AS impact, min(id) AS id FROM i GROUP BY 1, 2)
SELECT sector, id, impact, row_number() OVER (PARTITION BY sector ORDER BY CASE impact WHEN 'Positive' THEN 0 WHEN 'Neutral' THEN 1 ELSE 2 END, id) AS rank FROM f QUALIFY rank <= 4""")
def news_top4(spark: SparkSession, d: str) -> DataFrame:
    shape = F.col("id") % 12
    rows = _headlines(spark, d).withColumn("impact", F.when(shape.isin(0, 5, 6), "Positive").when(shape.isin(7, 10), "Negative").otherwise("Neutral"))
    one = rows.groupBy("sector", F.lower("title").alias("key")).agg(F.min_by("impact", "id").alias("impact"), F.min("id").alias("id")).drop("key")
    place = F.when(F.col("impact") == "Positive", 0).when(F.col("impact") == "Neutral", 1).otherwise(2)
    return sets.top_of(one, ["sector"], [place, F.col("id")], 4)


@query(f"""WITH x AS ({catalogue.SQL['decision_scoring']}) SELECT x.id, outcome, CAST(o_orderdate AS DATE) AS date FROM x JOIN orders ON id = o_orderkey WHERE outcome IN ('Thesis Playing Out', 'Underperforming') ORDER BY date DESC, id LIMIT 5""")
def recent_outcomes(spark: SparkSession, d: str) -> DataFrame:
    judged = catalogue.decision_scoring(spark, d).where(F.col("outcome").isin("Thesis Playing Out", "Underperforming"))
    return judged.join(table(spark, d, "orders"), F.col("id") == F.col("o_orderkey")).select("id", "outcome", F.to_date("o_orderdate").alias("date")).orderBy(F.desc("date"), "id").limit(5)


@query(f"""{_SIZED}, {_EVENTS}, ec AS (SELECT id, clause AS title FROM ev), {_match_sql('ec', 'ac')}, wn AS (SELECT ac.ticker, ev.direction, ev.id FROM ev JOIN ac ON ev.id = ac.id),
z AS (SELECT wn.ticker, wn.direction, count(*) AS headlines, max(round(mb.pct, 2)) FILTER (WHERE mb.sized) AS materiality_pct FROM wn JOIN mb ON mb.id = wn.id AND mb.ticker = wn.ticker GROUP BY 1, 2)
SELECT ticker, direction, headlines, materiality_pct, CASE WHEN direction = 'opportunity' AND materiality_pct >= 5 THEN 'Medium' ELSE 'Low' END AS severity FROM z""")
def escalated_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Moves of companies, each with its own headlines; an opportunity of which one tells of a large order rises by one severity."""
    found = attribution.events(_headlines(spark, d))
    actors = attribution.named(found.select("id", F.col("clause").alias("title")), _companies(spark, d))
    sources = found.join(actors, "id").groupBy("ticker", "direction").agg(F.collect_list(F.struct(F.col("type").alias("kind"), "title")).alias("sources"))
    warned = attribution.sized_warnings(sources.withColumn("severity", F.lit("Low")), ["ticker", "direction"], _revenue(spark, d))
    return rules.escalated(warned).select("ticker", "direction", F.size("sources").cast("long").alias("headlines"), "materiality_pct", "severity")


@query(f"""WITH m AS ({METRICS}), p AS (SELECT ticker, 'IN' || lpad(CAST(ticker - CASE WHEN ticker % 10 = 7 THEN 1 ELSE 0 END AS VARCHAR), 10, '0') AS code FROM m) SELECT a.ticker AS candidate, b.ticker AS holding, a.code FROM p a JOIN p b ON a.code = b.code AND a.ticker <> b.ticker WHERE a.ticker % 2 = 1 AND b.ticker % 2 = 0""")
def same_code_holdings(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are a holding under another ticker: equal codes, unequal tickers."""
    rows = holdings(spark, d).select("ticker", F.expr("'IN' || lpad(cast(ticker - if(ticker % 10 = 7, 1, 0) as string), 10, '0')").alias("code"))
    return rows.where("ticker % 2 = 1").withColumnRenamed("ticker", "candidate").join(rows.where("ticker % 2 = 0").withColumnRenamed("ticker", "holding"), "code").where("candidate <> holding")


@query(f"WITH x AS ({catalogue.SQL['thesis_health']}) SELECT ticker, sector, health FROM x ORDER BY CASE health WHEN 'Broken' THEN 0 WHEN 'Weakening' THEN 1 ELSE 2 END, ticker")
def thesis_order(spark: SparkSession, d: str) -> DataFrame:
    return views.in_thesis_order(catalogue.thesis_health(spark, d).select("ticker", "sector", "health"))


@query(f"WITH x AS ({catalogue.SQL['input_cost_shock']}) SELECT '' AS ticker, sector, CASE band WHEN 'severe' THEN 'High' ELSE 'Medium' END AS severity, CASE WHEN score > 0 THEN 'risk' ELSE 'opportunity' END AS direction, 'Input Cost Shock' AS category FROM x WHERE band <> 'quiet'")
def input_cost_warnings(spark: SparkSession, d: str) -> DataFrame:
    return views.input_cost_warnings(input_cost_shock(spark, d))


@query(f"""{VALUED}, v AS (SELECT *, {_GRAHAM} AS g FROM m) SELECT ticker, CASE WHEN eps <= 0 THEN 'Negative trailing earnings (TTM EPS ' || CAST(eps AS VARCHAR) || ')' WHEN q_opm < 0 THEN 'Operating loss in the latest quarter (OPM ' || CAST(q_opm AS VARCHAR) || '%)'
WHEN q_eps < 0 THEN 'Latest quarter swung to a loss (EPS ' || CAST(q_eps AS VARCHAR) || ')' ELSE 'Insufficient data for an honest estimate' END AS reason FROM v WHERE g = 0""")
def suppressed_values(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.graham(catalogue._valued(spark, d)).where("graham_value = 0")
    return rows.select("ticker", views.suppression_reason(F.col("eps"), F.col("q_opm"), F.col("q_eps"), F.lit(8)).alias("reason"))


_SCHEME = "CASE c_custkey % 5 WHEN 0 THEN 'Alpha ' || c_mktsegment || ' Infrastructure Fund' WHEN 1 THEN 'Beta Digital ' || c_mktsegment || ' Fund' WHEN 2 THEN 'Gamma Defence Fund ' || CAST(c_custkey % 20 AS STRING) WHEN 3 THEN 'Delta Manufacturing & Transport Fund' ELSE 'Plain ' || c_mktsegment || ' Fund' END || CASE c_custkey % 3 WHEN 0 THEN ' - Direct Plan - Growth' WHEN 1 THEN '-Quarterly IDCW' ELSE ' (Regular) Option' END"


@query(f"""WITH s AS (SELECT c_custkey AS code, {_SCHEME} AS name FROM customer), t AS (SELECT code, CASE WHEN contains(lower(name), 'manufacturing') OR contains(lower(name), 'make in india') THEN 'Manufacturing & PLI' WHEN regexp_matches(lower(name), 'semiconductor|technology|digital') THEN 'Semiconductors & Tech'
WHEN regexp_matches(lower(name), 'defence|defense|aerospace') THEN 'Defence & Aerospace' WHEN regexp_matches(lower(name), 'logistics|transport|infrastructure') THEN 'Logistics & Infra' END AS theme, trim(regexp_replace(replace(lower(name), '-', ' '), '\\s+[.,()]*(direct|regular|growth|idcw|dividend|payout|reinvestment|bonus|quarterly|monthly|annual|plan|option)[.,()]*(\\s.*|$)', '')) AS base FROM s),
f AS (SELECT theme, base, min(code) AS code FROM t WHERE theme IS NOT NULL GROUP BY 1, 2) SELECT theme, base, code, row_number() OVER (PARTITION BY theme ORDER BY code) AS rank FROM f QUALIFY rank <= 2""")
def thematic_schemes(spark: SparkSession, d: str) -> DataFrame:
    return views.thematic_schemes(table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.expr(_SCHEME).alias("name"), F.col("c_custkey").alias("place")))


@query(f"SELECT CAST(o_orderdate + INTERVAL 26 YEAR AS DATE) AS day, count(*) AS orders FROM orders WHERE isodow(o_orderdate + INTERVAL 26 YEAR) < 6 AND strftime(o_orderdate + INTERVAL 26 YEAR, '%Y-%m-%d') NOT IN ({_IN(views.HOLIDAYS)}) GROUP BY 1")
def trading_days(spark: SparkSession, d: str) -> DataFrame:
    """Orders on trading days, with their dates moved into the years that the calendar covers."""
    day = F.to_date(F.expr("o_orderdate + interval 26 years"))
    return table(spark, d, "orders").select(day.alias("day")).where(views.is_trading_day(F.col("day"))).groupBy("day").agg(F.count("*").alias("orders"))


_POLICY = "CASE o_orderkey % 4 WHEN 0 THEN 'Agreement' WHEN 1 THEN 'Launch' ELSE 'Filing' END"


@query(f"""WITH {_ISSUED}, pe AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN lower('T' || {_KEY}) ELSE name END AS company, {_POLICY} AS kind, o_orderpriority AS title FROM orders JOIN co ON s_suppkey = o_custkey WHERE o_orderkey % 5 = 0),
l AS (SELECT upper(company) AS k, kind || ': ' || title AS label FROM pe), b AS (SELECT ticker, label FROM co JOIN l ON upper(name) = k UNION SELECT ticker, label FROM co JOIN l ON upper(ticker) = k)
SELECT ticker, 'Medium' AS severity, 'opportunity' AS direction, 'Policy Catalyst' AS category, count(*) AS n_events, min(label) AS first_label FROM b GROUP BY 1""")
def policy_catalysts(spark: SparkSession, d: str) -> DataFrame:
    companies = _companies(spark, d)
    events = table(spark, d, "orders").where("o_orderkey % 5 = 0").join(companies, F.col("s_suppkey") == F.col("o_custkey"))
    named = F.when(F.col("o_orderkey") % 3 == 0, F.lower("ticker")).otherwise(F.col("name"))
    return views.policy_catalysts(companies, events.select(named.alias("company"), F.expr(_POLICY).alias("kind"), F.col("o_orderpriority").alias("title")))


@query(f"""WITH {_EVERY}, al AS (SELECT ticker, category, CASE WHEN ticker % 2 = 0 THEN upper(sector) ELSE 'nation ' || CAST(n_nationkey AS VARCHAR) END AS sector FROM aw JOIN nation ON sector = n_name),
na AS (SELECT n_nationkey AS key, lower(CAST(n_nationkey AS VARCHAR)) AS alias FROM nation UNION SELECT n_nationkey, lower(n_name) FROM nation UNION SELECT n_nationkey, 'nation ' || CAST(n_nationkey AS VARCHAR) FROM nation) SELECT CAST(key AS VARCHAR) AS key, count(*) AS warnings FROM al JOIN na ON lower(sector) = alias GROUP BY 1""")
def warnings_by_alias(spark: SparkSession, d: str) -> DataFrame:
    """Warnings that name their sector in one way or another, counted by the sector's key."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("label"))
    told = _all_warnings(spark, d).join(nations.withColumnRenamed("name", "sector"), "sector").select("ticker", "category", F.when(F.col("ticker") % 2 == 0, F.upper("sector")).otherwise(F.lower("label")).alias("sector"))
    return views.by_alias(told, nations).groupBy("key").agg(F.count("*").alias("warnings"))


@query(f"""WITH x AS ({catalogue.SQL['sector_valuation']}), s AS (SELECT DISTINCT sector, industry_pe FROM x), l AS (SELECT 'lowest' AS side, row_number() OVER (ORDER BY industry_pe, sector) AS rank, * FROM s), h AS (SELECT 'highest' AS side, row_number() OVER (ORDER BY industry_pe DESC, sector) AS rank, * FROM s)
SELECT * FROM l WHERE rank <= 3 UNION ALL SELECT * FROM h WHERE rank <= 3""")
def valuation_extremes(spark: SparkSession, d: str) -> DataFrame:
    return views.extremes(catalogue.sector_valuation(spark, d).select("sector", "industry_pe").distinct(), "industry_pe", "sector")


@query(f"WITH m AS ({METRICS}) SELECT ticker, name, sector FROM m WHERE contains(lower(CAST(ticker AS VARCHAR)), '1') OR contains(lower(sector), '1')")
def holdings_search(spark: SparkSession, d: str) -> DataFrame:
    return views.found_in(metrics(spark, d), "1", ["ticker", "sector"]).select("ticker", "name", "sector")


@query(f"""{VALUED}, v AS (SELECT *, {_GRAHAM} AS g, CASE WHEN roce > 15 THEN 1 ELSE 0 END + CASE WHEN roe > 15 THEN 1 ELSE 0 END + CASE WHEN debt / (0.5 * value) < 0.5 THEN 1 ELSE 0 END AS moat, coalesce(price < net_assets / CASE WHEN price > 0 THEN value / price ELSE 1.0 END, false) AS is_bargain FROM m WHERE value > 0),
f AS (SELECT *, current_ratio IS NOT NULL AND NOT (current_ratio < 2 OR debt > net_assets OR (pe > 15 AND NOT price <= g * 1.2) OR dividend = 0) AS is_defensive_pass FROM v)
SELECT ticker, g AS graham_value, is_bargain, is_defensive_pass, CASE moat WHEN 3 THEN 'Strong (Wide Moat)' WHEN 2 THEN 'Medium (Narrow Moat)' ELSE 'Weak/None' END AS moat_status, round(profit_var * 4 + debt * 0.08 - sales_var, 1) AS owner_earnings FROM f WHERE (is_defensive_pass OR is_bargain OR (pe > 0 AND pe < 15)) AND profit_var IS NOT NULL""")
def margin_of_safety(spark: SparkSession, d: str) -> DataFrame:
    rows = catalogue._valued(spark, d).where("value > 0 and profit_var is not null")
    return rules.margin_of_safety(rows.withColumns({"q_profit": F.col("profit_var"), "capex": F.col("sales_var")}))


_ENTRY = "CASE o_orderkey % 5 WHEN 0 THEN 'Omega' || CAST(o_custkey % 40 AS STRING) || ' eyes CCTV market' WHEN 1 THEN 'India sets up solar module park' WHEN 2 THEN 'Beta' || CAST(o_custkey % 30 * 3 + 1 AS STRING) || ' enters solar cells' WHEN 3 THEN 'T' || CAST(o_custkey AS STRING) || ' to make wafer tubes' ELSE 'Nothing on wafers' END"


@query(f"""WITH {_ISSUED}, en AS (SELECT o_orderkey AS id, o_orderkey % 5 AS shape, o_custkey, {_ENTRY} AS title FROM orders), {_TURF},
mv AS (SELECT id, title, CASE shape WHEN 0 THEN 'Omega' || CAST(o_custkey % 40 AS VARCHAR) WHEN 2 THEN 'Beta' || CAST(o_custkey % 30 * 3 + 1 AS VARCHAR) WHEN 3 THEN NULL END AS nm, CASE shape WHEN 3 THEN 'T' || CAST(o_custkey AS VARCHAR) END AS tk FROM en WHERE shape <> 4),
wh AS (SELECT mv.*, co.ticker, co.sector AS own, co.name AS cname FROM mv LEFT JOIN co ON co.ticker = mv.tk OR co.name = mv.nm), x AS (SELECT wh.id, tf.sector, coalesce(CASE WHEN ticker IS NOT NULL THEN cname END, nm) AS challenger FROM wh JOIN tf ON contains(lower(title), term) WHERE (own IS NULL OR own <> tf.sector) AND tf.sector IN (SELECT sector FROM co)),
f AS (SELECT sector, lower(challenger) AS k, arg_min(challenger, id) AS challenger, min(id) AS id FROM x WHERE challenger IS NOT NULL GROUP BY 1, 2) SELECT sector, challenger, id FROM f""")
def new_entrants(spark: SparkSession, d: str) -> DataFrame:
    companies = _companies(spark, d)
    titles = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_ENTRY).alias("title"))
    return attribution.new_entrants(titles, _turf(spark, d), companies, companies.select("ticker", "name", F.col("s_suppkey").alias("place")))


@query(f"WITH {_ISSUED}, e AS ({catalogue.SQL['new_entrants']}) SELECT ticker, e.sector, challenger, 'High' AS severity, 'risk' AS direction, 'New Entrant' AS category FROM e JOIN co ON e.sector = co.sector")
def entrant_warnings(spark: SparkSession, d: str) -> DataFrame:
    return attribution.entrant_warnings(new_entrants(spark, d), _companies(spark, d))


_DEAL = "CASE o_orderkey % 3 WHEN 0 THEN 'Fund ' || CAST(o_custkey AS STRING) || ' buys 5 lakh shares in Acme Works via block deal' WHEN 1 THEN 'Omega Capital offloads 2.5% stake in Beta' || CAST(o_custkey AS STRING) ELSE 'Talk of a deal' END"


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Fund ' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'Omega Capital' ELSE 'Institutional Investor' END AS buyer, CASE o_orderkey % 3 WHEN 1 THEN 'Sell' ELSE 'Buy' END AS action,
CASE o_orderkey % 3 WHEN 0 THEN 'Acme Works' WHEN 1 THEN 'Beta' || CAST(o_custkey AS VARCHAR) ELSE 'Listed Company' END AS company, CASE o_orderkey % 3 WHEN 0 THEN '5 lakh shares' WHEN 1 THEN '2.5% stake' ELSE 'Block Deal' END AS details FROM orders""")
def block_deals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), H.block_deal(F.expr(_DEAL)).alias("deal")).select("id", "deal.*")
