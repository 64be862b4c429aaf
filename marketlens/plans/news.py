"""Registered queries over collected feeds: what counts for whom, how it reads, what the run could not see.

The headlines of ``research`` are dealt over the feeds by their keys. Some repeat with other marks, some have no day, and
some launches and filings have a subject that is not their title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import news
from marketlens.plans import catalogue, research
from marketlens.plans.catalogue import METRICS, query
from marketlens.sources.tables import metrics, table

_FEED = "CASE WHEN id % 7 < 3 THEN 'sector' WHEN id % 7 = 3 THEN 'agreements' WHEN id % 7 = 4 THEN 'launches' WHEN id % 7 = 5 THEN 'filings' ELSE 'global' END"
_TOLD = "concat(title, CASE WHEN id % 5 = 0 THEN '!' ELSE '' END)"
_SUBJECT = "CASE WHEN id % 7 IN (4, 5) AND id % 3 <> 2 THEN told END"
_ITEM_TITLE = "CASE WHEN id % 7 IN (4, 5) AND id % 3 = 1 THEN 'Untold' ELSE told END"
_COLLECTED = f"it AS (SELECT id, feed, sector, told AS title, {_ITEM_TITLE} AS own, {_SUBJECT} AS subject, day FROM (SELECT id, sector, {_FEED} AS feed, {_TOLD} AS told, CASE WHEN id % 13 <> 0 THEN day END AS day FROM hl))"
_PLACE = "list_position(['sector', 'agreements', 'launches', 'filings', 'global', 'events'], feed)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = research._headlines(spark, d).select("id", "sector", F.expr(_FEED).alias("feed"), F.expr(_TOLD).alias("told"), F.when(F.col("id") % 13 != 0, F.col("day")).alias("day"))
    return rows.select("feed", F.col("id").alias("place"), "sector", F.expr(_ITEM_TITLE).alias("title"), F.expr(_SUBJECT).alias("subject"), "day")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    events = research._market_events(spark, d).select(F.lit("events").alias("feed"), F.col("id").alias("place"), "title", "day", "type", F.transform("actors", lambda x: F.lower(x)).alias("actors"))
    both = _items(spark, d).unionByName(events, allowMissingColumns=True)
    return news.audit(both, research._companies(spark, d), research._today(research._headlines(spark, d)).scalar())


@query(f"""WITH {research._ISSUED}, {_COLLECTED}, h AS (SELECT feed, id, trim(CASE WHEN feed IN ('launches', 'filings') THEN subject ELSE own END) AS headline FROM it)
SELECT headline, feed, id AS place FROM h WHERE headline <> '' QUALIFY row_number() OVER (PARTITION BY lower(headline) ORDER BY {_PLACE}, id) = 1""")
def collected_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Every headline of all feeds once."""
    return news.collected(_items(spark, d))


_AUDITED = f"""{research._TRACKED}, {_COLLECTED}, {research._match_sql('it', 'mi')},
own AS (SELECT mi.ticker, feed, it.id, it.title, day, '' AS type FROM it JOIN mi ON it.id = mi.id JOIN co ON co.ticker = mi.ticker WHERE feed <> 'sector' OR it.sector = co.sector
  UNION ALL SELECT unnest(string_split(actors, '; ')), 'events', id, title, day, type FROM me WHERE actors <> ''),
kk AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9 ]+', '', 'g')) AS k, date_diff('day', day, (SELECT max(day) FROM hl)) AS age, ({_PLACE}, id) AS seat FROM own),
fi AS (SELECT ticker, k, min(seat) AS f, arg_min(left(title, 60), seat) AS said FROM kk WHERE coalesce(age, 0) <= 120 GROUP BY 1, 2),
au AS (SELECT kk.*, CASE WHEN seat > f THEN 'merged' WHEN age > 120 THEN 'excluded' ELSE 'counted' END AS status, CASE WHEN seat > f THEN 'merged: duplicate phrasing of “' || said || '”' WHEN age > 120 THEN 'aged >120d (' || CAST(age AS VARCHAR) || ' days old)' ELSE '' END AS reason
  FROM kk LEFT JOIN fi ON fi.ticker = kk.ticker AND fi.k = kk.k WHERE kk.k <> '')"""


@query(f"""{_AUDITED} SELECT ticker, feed, id AS place, title AS headline, CASE WHEN type <> '' THEN type || '; ' ELSE '' END || ['Sector news', 'Agreement', 'Launch', 'Filing', 'Global', 'Event'][{_PLACE}] AS tags,
CASE feed WHEN 'events' THEN 'H' WHEN 'global' THEN 'L' ELSE 'M' END AS confidence, status, reason FROM au""")
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every item of every feed that tells of a company: counted, merged or excluded, with the reason."""
    return _audit(spark, d).select("ticker", "feed", "place", "headline", F.array_join("tags", "; ").alias("tags"), "confidence", "status", F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"{_AUDITED} SELECT feed, confidence, status, count(*) AS n, count(DISTINCT ticker) AS companies FROM (SELECT *, CASE feed WHEN 'events' THEN 'H' WHEN 'global' THEN 'L' ELSE 'M' END AS confidence FROM au) GROUP BY 1, 2, 3")
def coverage_by_feed(spark: SparkSession, d: str) -> DataFrame:
    """How much of each feed counts."""
    return _audit(spark, d).groupBy("feed", "confidence", "status").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("companies"))


_LEXICON = (("strong", 2.3), ("rally", 1.5), ("rises", 0.9), ("record", 1.1), ("denies", -1.4), ("shortage", -2.1), ("slip", -1.2), ("risk", -1.6))
_SUMMARY = "CASE id % 9 WHEN 0 THEN 'A strong, strong start' WHEN 1 THEN 'Penalty and curb' WHEN 2 THEN 'Launch after a delay' WHEN 3 THEN 'risk of shortage' WHEN 4 THEN 'strong-willed' WHEN 5 THEN NULL ELSE '' END"


@query(f"""WITH {research._ISSUED}, lx AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {v})" for w, v in _LEXICON)}) v(word, valence)), tx AS (SELECT id, lower(title || '. ' || coalesce({_SUMMARY}, '')) AS text FROM hl),
sc AS (SELECT id, CAST(sum(CAST(valence AS DECIMAL(9,3))) AS DOUBLE) AS s FROM (SELECT id, unnest(regexp_extract_all(text, '[\\p{{L}}''-]+')) AS word FROM tx) w JOIN lx ON w.word = lx.word GROUP BY 1), v AS (SELECT tx.id, text, coalesce(s / sqrt(s * s + 15), 0) AS score FROM tx LEFT JOIN sc ON sc.id = tx.id)
SELECT id, round(score, 6) AS score, CASE WHEN score >= 0.2 THEN 'Positive' WHEN score <= -0.2 THEN 'Negative' WHEN regexp_matches(text, '{'|'.join(news.GOOD)}') THEN 'Positive' WHEN regexp_matches(text, '{'|'.join(news.BAD)}') THEN 'Negative' ELSE 'Neutral' END AS impact FROM v""")
def headline_tone(spark: SparkSession, d: str) -> DataFrame:
    """How each headline reads, with what is told below it."""
    rows = research._headlines(spark, d).select("id", "title", F.expr(_SUMMARY).alias("summary"))
    return news.toned(rows, spark.createDataFrame(list(_LEXICON), "word string, valence double")).withColumn("score", F.round("score", 6))


# a sector depends on one brand; brands whose number ends in 3 were not priced
_BRAND = "concat('Brand#', CAST(n_nationkey % 5 + 1 AS {0}), CAST(CAST(floor(n_nationkey / 5) AS INT) % 5 + 1 AS {0}))"


@query(f"""WITH m AS ({METRICS}), pe AS ({catalogue.SQL['potential_estimate']}), ic AS (SELECT *, change IS NOT NULL AND input NOT LIKE '%3' AS priced FROM ({catalogue.SQL['input_cost_moves']})), cc AS ({catalogue.SQL['coverage_counts']}), ew AS ({catalogue.SQL['escalated_warnings']}),
held AS (SELECT count(*) AS held, count(*) FILTER (WHERE price <> 0) AS updated, count(*) FILTER (WHERE method = 'No Estimate') AS blind, count(pledged) AS pledges FROM m LEFT JOIN pe ON pe.ticker = m.ticker),
cov AS (SELECT count(*) AS asked, count(*) FILTER (WHERE counted > 0) AS covered FROM cc), inp AS (SELECT count(*) FILTER (WHERE priced) AS priced, count(*) FILTER (WHERE NOT priced) AS unpriced FROM ic),
mis AS (SELECT string_agg(input, ', ' ORDER BY input) AS names FROM (SELECT input FROM ic WHERE NOT priced ORDER BY input LIMIT 4)), sh AS (SELECT count(*) AS shocked FROM nation JOIN ic ON {_BRAND.format('VARCHAR')} = input WHERE priced AND band IN ('material', 'severe')), sz AS (SELECT count(materiality_pct) AS sized FROM ew),
al AS (SELECT * FROM held, cov, inp, mis, sh, sz)
SELECT 'Live prices' AS topic, CASE WHEN updated / held * 100 >= 95 THEN 'good' WHEN updated / held * 100 >= 80 THEN 'fair' ELSE 'poor' END AS level, CAST(updated AS VARCHAR) || '/' || CAST(held AS VARCHAR) || ' holdings refreshed (' || CAST(CAST(round_even(updated / held * 100, 0) AS INT) AS VARCHAR) || '%).' AS note FROM al
UNION ALL SELECT 'News coverage', 'info', CAST(covered AS VARCHAR) || ' of ' || CAST(asked AS VARCHAR) || ' holdings had attributable items.' FROM al WHERE asked > 0
UNION ALL SELECT 'Estimates suppressed', 'fair', CAST(blind AS VARCHAR) || ' of ' || CAST(held AS VARCHAR) || ' holdings carry no target, because neither analyst coverage nor a usable fundamental base was available.' FROM al WHERE blind > 0
UNION ALL SELECT 'Promoter pledging', 'info', CAST(pledges AS VARCHAR) || ' of ' || CAST(held AS VARCHAR) || ' holdings disclosed a pledge figure; the rest are unread, not confirmed unpledged.' FROM al
UNION ALL SELECT 'Input costs', 'info', CAST(priced AS VARCHAR) || ' input(s) priced; ' || CAST(shocked AS VARCHAR) || ' sector(s) carrying a material move.' FROM al WHERE priced > 0
UNION ALL SELECT 'Inputs not priced', 'poor', names || CASE WHEN unpriced > 4 THEN ', and ' || CAST(unpriced - 4 AS VARCHAR) || ' more' ELSE '' END || ' — treated as unmeasured, not as unchanged.' FROM al WHERE unpriced > 0
UNION ALL SELECT 'Order sizing', 'info', CAST(sized AS VARCHAR) || ' alert(s) measured against trailing revenue; the rest carried no attributable figure.' FROM al WHERE sized > 0""")
def data_quality(spark: SparkSession, d: str) -> DataFrame:
    """What the run could not see."""
    companies = metrics(spark, d).select("ticker", (F.col("price") != 0).alias("refreshed"), "pledged").join(catalogue.potential_estimate(spark, d).select("ticker", "method"), "ticker", "left")
    moves = catalogue.input_cost_moves(spark, d).withColumn("priced", F.col("change").isNotNull() & ~F.col("input").endswith("3"))
    sectors = table(spark, d, "nation").select(F.col("n_name").alias("sector"), F.expr(_BRAND.format("STRING")).alias("input")).join(moves.where("priced"), "input")
    inputs = moves.select(F.lit(0).alias("place"), F.col("input").alias("label"), "priced")
    return news.data_quality(companies, research.coverage_counts(spark, d), inputs, sectors, research.escalated_warnings(spark, d)).drop("place")
