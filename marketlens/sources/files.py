"""Files of the research runs as tables: scans that stand missing or broken files, and writers.

Scans return an empty table of the right columns where a file is missing or cannot be read as what it should be, so
that one bad file never stops a run.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.coerce import to_number
from marketlens.sources import publish

HOLDING = "sector string, ord int, ticker string, name string, catalyst string, price double, target double, growth_pct double, raw string"
# fixed values: the fields of a record, by how files spell them
MONEY = ("price", "target", "target_median", "target_high", "target_low")
PERCENTS = ("growth_pct", "revenue_growth", "earnings_growth")
NUMBERS = (*MONEY, *PERCENTS, "rec_score", "fundamental_value")
KNOWN = ("ticker", "name", "catalyst", "rating", "analyst_count", *NUMBERS)
# fixed values: the kinds of edges
EDGE_TYPES = ("anchor_demand", "supplier_customer", "partner", "competitor", "input_cost")
EDGE = "src string, dst string, type string, note string, evidence string, added string"
DECISION = "date date, action string, sector string, ticker string, name string, price_at_decision double, target_at_decision double, scored boolean, outcome string"


def _text(spark: SparkSession, path: str) -> DataFrame:
    """value: the whole file as one text; no row if there is none."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "value string")


def watchlist(spark: SparkSession, path: str, seed: dict[str, list[dict]] | None = None) -> DataFrame:
    """{sector: [company, ...]} -> one row a company, in the list's order (ord), with typed figures and the record as it was (raw).

    Display texts such as "1,840.00" or "+23.0%" become numbers, what is no number null. Without a readable file the
    seed takes its place.
    """
    parsed = _text(spark, path).select(F.from_json("value", "map<string, array<string>>").alias("m")).where("m is not null and size(m) > 0")
    if seed and parsed.isEmpty():
        import json

        parsed = spark.createDataFrame([({k: [json.dumps(x) for x in v] for k, v in seed.items()},)], "m map<string, array<string>>")
    rows = parsed.select(F.explode("m").alias("sector", "list")).select("sector", F.posexplode("list").alias("ord", "raw"))
    told = F.from_json("raw", "ticker string, name string, catalyst string, price string, target string, growth_pct string")
    rows = rows.select("sector", "ord", told.alias("r"), "raw")
    return rows.select("sector", "ord", "r.ticker", "r.name", "r.catalyst", *[to_number(F.col(f"r.{c}")).alias(c) for c in ("price", "target", "growth_pct")], "raw")


def _known(record: Column) -> list[Column]:
    """The typed columns of a record; what is no number is null, a missing rating has its own mark."""
    text = lambda c: F.try_variant_get(record, f"$.{c}", "string")
    numbers = [to_number(text(c)).alias(c) for c in NUMBERS]
    names = [text("ticker").alias("ticker"), *[F.coalesce(text(c), F.lit("")).alias(c) for c in ("name", "catalyst")], F.coalesce(text("rating"), F.lit("N/A")).alias("rating")]
    return [*names, *numbers, to_number(text("analyst_count")).cast("int").alias("analyst_count")]


def records(spark: SparkSession, path: str) -> DataFrame:
    """A watchlist's records with all their fields: sector, ord, the typed columns, rest, valid and raw.

    Fields that this release does not know are kept in ``rest``, a VARIANT, under their names; it is null if there are
    none. A record without a ticker, or one whose texts are no texts, is not valid: its typed columns are null and ``raw``
    (VARIANT) holds it as it was, so that nothing is lost. A list that is no list, and what is no object, are such records.
    """
    parsed = _text(spark, path).select(F.from_json("value", "map<string, variant>").alias("m")).where("m is not null")
    lists = parsed.select(F.explode("m").alias("sector", "list")).select("sector", "list", F.try_variant_get("list", "$", "array<variant>").alias("items"))
    rows = lists.select("sector", F.posexplode(F.coalesce("items", F.array("list"))).alias("ord", "raw"))
    fields = F.try_variant_get("raw", "$", "map<string, variant>")
    typed = F.schema_of_variant(F.coalesce(F.try_variant_get("raw", "$.ticker", "variant"), F.parse_json(F.lit("null"))))
    loose = [F.schema_of_variant(F.coalesce(F.try_variant_get("raw", f"$.{c}", "variant"), F.parse_json(F.lit('""')))) != "STRING" for c in ("name", "catalyst")]
    rows = rows.withColumns({"fields": fields, "valid": (typed == "STRING") & ~(loose[0] | loose[1])}).withColumn("valid", F.coalesce("valid", F.lit(False)))
    other = F.map_filter("fields", lambda k, _: ~k.isin(*KNOWN))
    rest = F.when(F.col("valid") & (F.size(other) > 0), F.to_variant_object(other)).alias("rest")
    known = F.when(F.col("valid"), F.struct(*_known(F.col("raw")))).alias("k")
    return rows.select("sector", "ord", known, rest, "valid", "raw").select("sector", "ord", "k.*", "rest", "valid", "raw")


def wire(rows: DataFrame) -> DataFrame:
    """records() -> sector, ord, record: each as JSON, typed fields in the form of the files, others as they came; a bad one as it was.

    Money has two decimals, percentages one and a plus sign over zero. Only fields that the record had are written.
    """
    money = {c: F.format_string("%.2f", c) for c in MONEY}
    percent = {c: F.concat(F.when(F.col(c) > 0, "+").otherwise(""), F.format_string("%.1f%%", c)) for c in PERCENTS}
    had = F.try_variant_get("raw", "$", "map<string, variant>")
    text = lambda c: F.when(F.col(c).isNotNull(), (money | percent)[c]) if c in money | percent else F.col(c)
    told = F.to_json(F.struct(*[text(c).alias(c) for c in KNOWN]), {"ignoreNullFields": "false"})
    fields = F.from_json(told, "map<string, variant>")
    merged = F.map_from_entries(F.transform(F.map_keys("had"), lambda k: F.struct(k, F.when(k.isin(*KNOWN), F.element_at("fields", k)).otherwise(F.element_at("had", k)))))
    rows = rows.withColumns({"had": had, "fields": fields})
    return rows.select("sector", "ord", F.when(F.col("valid"), F.to_json(F.to_variant_object(merged))).otherwise(F.to_json("raw")).alias("record"))


def entity_graph(spark: SparkSession, path: str, kinds: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """{"edges": [...]} -> edges with both ends and a known type."""
    rows = _text(spark, path).select(F.inline(F.from_json("value", f"edges array<struct<{EDGE}>>")["edges"]))
    return rows.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "") & F.col("type").isin(*kinds))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A list of decisions; anything but a list is an empty ledger."""
    return _text(spark, path).where(r"value rlike '^\\s*\\['").select(F.inline(F.from_json("value", f"array<struct<{DECISION}>>")))


def isin_is_valid(isin: Column) -> Column:
    return (F.length(isin) == 12) & isin.startswith("IN")


def isin_master(spark: SparkSession, path: str) -> DataFrame:
    """{symbol: isin} -> symbol (upper case), isin; invalid ones go."""
    rows = _text(spark, path).select(F.explode(F.from_json("value", "map<string, string>")).alias("symbol", "isin"))
    return rows.where(isin_is_valid(F.col("isin"))).select(F.upper("symbol").alias("symbol"), "isin")


def equity_csv(spark: SparkSession, path: str) -> DataFrame:
    """symbol, isin from an exchange's list, whose column names may have spaces around them."""
    read = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    read = read.toDF(*[c.strip().upper() for c in read.columns])
    rows = read.select(F.upper(F.trim("SYMBOL")).alias("symbol"), F.upper(F.trim("`ISIN NUMBER`")).alias("isin"))
    return rows.where((F.coalesce("symbol", F.lit("")) != "") & isin_is_valid(F.col("isin")))


def previous_run(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table of the run before, as write_run() left it or as plain Parquet files of earlier releases; empty if there was none."""
    if publish.current_version(spark, folder) is not None:
        return publish.read(spark, folder, schema=schema)
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_run(frame: DataFrame, folder: str, partition: str | None = None, order: list[str] | None = None) -> None:
    """Replaces a table; readers see the old or the new one, see publish. With a partition, a folder for each of its values, stale ones gone."""
    publish.publish(frame, folder, partitions={"rows": partition} if partition else None, orders={"rows": order} if order else None)


def write_briefing(corpus: DataFrame, display: DataFrame, coverage: DataFrame, folder: str, version: str | None = None) -> str:
    """A run's corpus, what the dashboard shows of it, and the coverage of each ticker, all under one version.

    Coverage is sorted by ticker across files, so that a lookup reads one or two of them; a folder for each ticker would
    make as many files as there are companies.
    """
    safe = F.regexp_replace(F.upper("ticker"), "[^A-Z0-9_-]", "")
    sidecars = coverage.withColumn("ticker", safe).where("ticker <> ''")
    return publish.publish({"corpus": corpus, "display": display, "coverage": sidecars}, folder, version, orders={"coverage": ["ticker"]})
