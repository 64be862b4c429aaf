"""Streams that keep tables: replays, failures, late rows and rules that change between batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from marketlens.functions import headlines as H
from marketlens.operators import rules
from marketlens.sources import publish
from marketlens.streaming import state, stores
from marketlens.streaming.incremental import drained

DAY = datetime.date(2026, 8, 1)
TITLE = "id string, title string, day date"


def _day(n):
    return DAY + datetime.timedelta(days=n)


def test_corpus(spark, tmp_path):
    folder, rule = str(tmp_path / "c"), {"companies": [("ITC", "ITC"), ("SUZLON", "Suzlon")]}
    terms = lambda: spark.createDataFrame([(k, t) for k, ts in H.BATTLEGROUNDS.items() for t in ts], "sector string, term string")
    companies = lambda: spark.createDataFrame(rule["companies"], "ticker string, name string")
    keep = stores.corpus_keeper(folder, terms, companies)
    batch = lambda *rows: spark.createDataFrame(list(rows), TITLE)
    held = lambda: {r["id"]: r["actors"] for r in publish.read(spark, folder).collect()}

    first = batch(("1", "ITC wins order", _day(0)), ("2", "Shortage of wafers", _day(0)), ("3", "Acme wins order", _day(0)), ("4", "Suzlon says hello", _day(0)), ("1", "ITC wins order", _day(0)))
    keep(first, 0)
    assert held() == {"1": ["ITC"], "2": []}
    # the same batch again, and one that holds known ids
    keep(first, 0)
    keep(batch(("1", "Suzlon wins order", _day(1)), ("5", "Suzlon wins order", _day(30))), 1)
    assert held() == {"1": ["ITC"], "2": [], "5": ["SUZLON"]}
    # a second version of the list: what named ITC touches nothing now, and Acme is followed for what comes
    rule["companies"] = [("SUZLON", "Suzlon Energy (Suzlon)"), ("ACME", "Acme")]
    keep(batch(("6", "Acme bags order", _day(31))), 2)
    assert held() == {"2": [], "5": ["SUZLON"], "6": ["ACME"]}
    # late rows join while they are young enough; ages are measured from the newest day
    keep(batch(("7", "Acme wins contract", _day(46)), ("8", "Acme wins contract", _day(1)), ("9", "Acme wins contract", _day(0))), 3)
    assert held() == {"5": ["SUZLON"], "6": ["ACME"], "7": ["ACME"], "8": ["ACME"]}
    keep(batch(), 4)
    assert set(held()) == {"5", "6", "7", "8"}
    # a batch that dies leaves the table as it was, and succeeds when it is run again
    late = batch(("10", "Acme wins contract", _day(47)))
    with pytest.raises(Exception, match="dies"):
        keep(late.withColumn("title", F.raise_error(F.lit("dies")).cast("string")), 5)
    assert set(held()) == {"5", "6", "7", "8"}
    keep(late, 5)
    assert set(held()) == {"5", "6", "7", "10"}


def test_graph(spark, tmp_path):
    folder = str(tmp_path / "g")
    publish.publish({"edges": spark.createDataFrame([("b", "A", "partner", "kept", "by hand", "2020-01-01"), ("A", "c", "anchor_demand", None, None, None)], stores.EDGE)}, folder)
    companies = lambda: spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("C", "Gamma"), ("D", "Delta")], "ticker string, name string")
    rows = [("1", "Alpha partners with Beta", DAY), ("2", "Gamma in joint venture with Alpha and Delta", DAY), ("3", "Alpha and Gamma meet", DAY), ("4", "Delta ties up with Gamma", DAY), ("5", None, DAY)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows[:2], TITLE).coalesce(1).write.mode("append").parquet(source)

    def run():
        query = spark.readStream.schema(TITLE).parquet(source).writeStream.foreachBatch(stores.graph_grower(folder, companies)).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
        query.awaitTermination()
        return [(r["type"], r["src"], r["dst"]) for r in stores.in_graph_order(publish.read(spark, folder, "edges")).collect()]

    first = [("anchor_demand", "A", "c"), ("partner", "A", "C"), ("partner", "A", "D"), ("partner", "b", "A"), ("partner", "C", "D")]
    assert run() == first
    version = publish.current_version(spark, folder)
    # replay: the same batch once more, by its number and by its rows
    stores.graph_grower(folder, companies)(spark.createDataFrame(rows[:2], TITLE), 0)
    assert publish.current_version(spark, folder) == version
    stores.graph_grower(folder, companies, "again")(spark.createDataFrame(rows[:2], TITLE), 0)
    assert publish.read(spark, folder, "edges").count() == len(first)
    spark.createDataFrame(rows[2:], TITLE).coalesce(1).write.mode("append").parquet(source)
    assert run() == first
    kept = publish.read(spark, folder, "edges").where("note = 'kept'").collect()
    assert [(r["src"], r["evidence"], r["added"]) for r in kept] == [("b", "by hand", "2020-01-01")]
    assert publish.read(spark, folder, "edges").where("src = 'C' and dst = 'D'").first()["evidence"] == "Gamma in joint venture with Alpha and Delta"


def test_scored_stream(spark, tmp_path):
    """Decisions scored by a timer, equal to the batch form that knows all prices."""
    ts = lambda n, h=0: datetime.datetime(2026, 1, 1, h) + datetime.timedelta(days=n)
    asked = [("1", "A", ts(0), 100.0, 120.0), ("2", "A", ts(3), 110.0, 121.0), ("3", "B", ts(1), 50.0, 40.0), ("4", "C", ts(1), 50.0, 60.0), ("5", "D", ts(2), 0.0, 60.0), ("6", "A", ts(60), 100.0, 120.0), ("7", "E", ts(2), 10.0, 12.0), ("8", "E", ts(2), None, 12.0), ("9", "E", ts(3), 10.0, 12.0)]
    told = [("A", ts(-2), 99.0), ("A", ts(40), 109.0), ("A", ts(46), 130.0), ("A", ts(48), 115.6), ("A", ts(49), 1.0), ("B", ts(20), 60.0), ("D", ts(5), 9.0), ("E", ts(46), 11.0), ("E", ts(48), None), ("Z", ts(100), 1.0), ("Z", ts(120), 1.0)]
    kinds = ("id string, ticker string, ts timestamp, price double, target double", "ticker string, ts timestamp, price double")
    folders = [str(tmp_path / x) for x in ("d", "p")]
    cuts = (ts(-1), ts(2), ts(47), ts(70), ts(110), ts(200))
    for low, high in zip((ts(-9), *cuts), cuts, strict=False):
        # what comes in one step is mixed; a price of before a decision comes first
        for rows, at, kind, folder in ((asked, 2, kinds[0], folders[0]), (told, 1, kinds[1], folders[1])):
            some = [r for r in rows if low <= r[at] < high]
            spark.createDataFrame(some, kind).coalesce(1).write.mode("append").parquet(folder)
    read = lambda k: spark.readStream.schema(kinds[k]).option("maxFilesPerTrigger", 1).parquet(folders[k])
    got = {r["id"]: (r["price"], r["realized_return_pct"], r["outcome"]) for r in drained(state.scored_stream(read(0), read(1)), str(tmp_path / "k")).collect()}

    def price(ticker, due):
        known = sorted((t, p) for x, t, p in told if x == ticker and t <= due)
        return known[-1][1] if known else None

    rows = [(i, x, t.date(), (t + datetime.timedelta(days=45)).date(), p, g, price(x, t + datetime.timedelta(days=45))) for i, x, t, p, g in asked if p is not None]
    frame = spark.createDataFrame(rows, "id string, ticker string, date date, today date, price_at_decision double, target_at_decision double, price double")
    want = {r["id"]: (r["price"], r["realized_return_pct"], r["outcome"]) for r in rules.scored_decisions(frame).collect()}
    assert got == want and got["1"][2] == "Underperforming" and got["2"] == (115.6, 5.1, "Thesis Playing Out") and got["9"][2] == "Left Watchlist (unscored)"
