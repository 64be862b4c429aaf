"""Feeds, the audit of what counts, tone and what a run could not see."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlens.operators import news

DAY = datetime.date(2026, 8, 20)
COMPANIES = [("SUZLON", "Suzlon Energy", "clean_energy"), ("acme", "Acme Tools", "machines")]
ITEM = "feed string, place int, sector string, title string, subject string, day date, type string, actors array<string>"


def _ago(days):
    return DAY - datetime.timedelta(days=days)


def _item(feed, place, title, day=1, sector=None, subject=None, type=None, actors=None):
    return (feed, place, sector, title, subject, None if day is None else _ago(day), type, actors)


def _audit(spark, rows):
    frame = spark.createDataFrame(rows, ITEM)
    return news.audit(frame, spark.createDataFrame(COMPANIES, "ticker string, name string, sector string"), F.lit(DAY)).orderBy("ticker", "feed", "place").collect()


def test_audit_only_headlines_that_name_the_company(spark):
    got = _audit(spark, [_item("sector", 1, "Suzlon Energy wins 300 MW order", sector="clean_energy"), _item("sector", 2, "Some other company wins an order", sector="clean_energy"), _item("sector", 3, "Suzlon Energy seen elsewhere", sector="machines"), _item("unknown", 4, "Suzlon Energy again")])
    assert [(r.ticker, r.place, r.status, r.confidence, r.reason, r.tags) for r in got] == [("SUZLON", 1, "counted", "M", None, ["Sector news"])]


# fixed values: what counts of three items, and what the reasons say
def test_audit_merged_and_aged(spark):
    got = _audit(spark, [_item("sector", 1, "Suzlon Energy wins 300 MW order", sector="clean_energy"), _item("sector", 2, "suzlon energy wins 300 MW order.", sector="clean_energy"), _item("sector", 3, "Suzlon Energy commissions plant", 400, "clean_energy")])
    assert [(r.place, r.status) for r in got] == [(1, "counted"), (2, "merged"), (3, "excluded")]
    assert got[1].reason == "merged: duplicate phrasing of “Suzlon Energy wins 300 MW order”" and got[2].reason == "aged >120d (400 days old)"


def test_audit_edges(spark):
    long = "Suzlon Energy " + "x" * 100
    rows = [
        _item("global", 1, "Suzlon Energy is back", 120), _item("global", 2, "Suzlon Energy is old", 121), _item("global", 3, "Suzlon Energy is old", None), _item("global", 4, "Suzlon Energy is old", 300),
        _item("agreements", 9, "Suzlon Energy is old", 500), _item("launches", 5, "Nothing", 1, subject=long), _item("filings", 6, long + "!", 1, subject=""), _item("launches", 7, None), _item("filings", 8, ""),
        _item("events", 1, "Order secured", 1, type="order_win", actors=["suzlon", "SUZLON", "nobody", None]), _item("events", 2, "Order: secured", 1, type="", actors=["Suzlon", "Acme"]), _item("events", 3, "??", 1, actors=["ACME"]), _item("events", 4, "No actor", 1), _item("global", 10, "Acme Tools and Suzlon Energy tie up", 1),
    ]
    got = {(r.ticker, r.feed, r.place): (r.status, r.confidence, r.tags, r.reason) for r in _audit(spark, rows)}
    assert got == {
        ("SUZLON", "global", 1): ("counted", "L", ["Global"], None),
        # too old, and no later one stands before them
        ("SUZLON", "agreements", 9): ("excluded", "M", ["Agreement"], "aged >120d (500 days old)"), ("SUZLON", "global", 2): ("excluded", "L", ["Global"], "aged >120d (121 days old)"),
        # without a day an item is not old; what comes after is merged with it, old or not
        ("SUZLON", "global", 3): ("counted", "L", ["Global"], None), ("SUZLON", "global", 4): ("merged", "L", ["Global"], "merged: duplicate phrasing of “Suzlon Energy is old”"),
        ("SUZLON", "launches", 5): ("counted", "M", ["Launch"], None), ("SUZLON", "filings", 6): ("merged", "M", ["Filing"], f"merged: duplicate phrasing of “{long[:60]}”"),
        ("SUZLON", "events", 1): ("counted", "H", ["order_win", "Event"], None), ("SUZLON", "events", 2): ("merged", "H", ["Event"], "merged: duplicate phrasing of “Order secured”"), ("ACME", "events", 2): ("counted", "H", ["Event"], None),
        ("ACME", "global", 10): ("counted", "L", ["Global"], None), ("SUZLON", "global", 10): ("counted", "L", ["Global"], None),
    }
    assert _audit(spark, []) == []


def test_audit_of_one_headline_that_all_repeat(spark):
    rows = spark.range(3000).select(F.lit("global").alias("feed"), (F.col("id") + 1).alias("place"), F.lit("Suzlon Energy wins").alias("title"), F.lit(DAY).alias("day"), F.lit("clashing").alias("headline"), F.lit("clashing").alias("rank"))
    got = news.audit(rows, spark.createDataFrame(COMPANIES, "ticker string, name string, sector string"), F.lit(DAY))
    assert {r.status: (r["count"], r.first) for r in got.groupBy("status").agg(F.count("*").alias("count"), F.min("place").alias("first")).collect()} == {"counted": (1, 1), "merged": (2999, 2)}


def test_collected(spark):
    rows = [_item("global", 1, " Same "), _item("sector", 7, "same"), _item("launches", 1, "title", subject="SAME"), _item("launches", 2, "untold"), _item("filings", 1, "x", subject=" filed\n"), _item("events", 1, "event"), _item("agreements", 1, None), _item("agreements", 2, " "), _item("sector", 3, "Other")]
    got = news.collected(spark.createDataFrame(rows, ITEM)).orderBy("headline").collect()
    assert [tuple(r) for r in got] == [("Other", "sector", 3), ("filed", "filings", 1), ("same", "sector", 7)]
    assert news.collected(spark.createDataFrame([], ITEM)).collect() == []


# fixed values: words decide where no score does, good ones first; else the score, from 0.2 on
@pytest.mark.parametrize(("text", "score", "want"), [("Subsidy after a DELAY", None, "Positive"), ("fine weather", None, "Negative"), ("weather", None, "Neutral"), (None, None, "Neutral"), ("loss", 0.2, "Positive"), ("launch", -0.2, "Negative"), ("loss", 0.19, "Negative"), ("launch", -0.19, "Positive"), ("", 0.0, "Neutral")])
def test_tone(spark, text, score, want):
    row = spark.createDataFrame([(text, score)], "t string, s double")
    assert row.select(news.tone(F.col("t"), F.col("s")).alias("x")).first().x == want
    if score is None:
        assert row.select(news.tone(F.col("t")).alias("x")).first().x == want


def test_toned_counts_every_word(spark):
    rows = [(1, "Good GOOD", "good-bad bad"), (2, None, None), (3, "bad", None), (4, "so-so", "well'd " * 5000)]
    lexicon = [("good", 2.0), ("bad", -1.5), ("BAD", -1.0), ("well'd", 0.5), (None, 9.0)]
    got = {r.id: (r.score, r.impact) for r in news.toned(spark.createDataFrame(rows, "id int, title string, summary string"), spark.createDataFrame(lexicon, "word string, valence double")).collect()}
    listed = {"good": 2.0, "bad": -1.5, "well'd": 0.5}

    def brute(title, summary):
        words = Counter(f"{title or ''}. {summary or ''}".lower().replace(".", " ").split())
        s = sum(n * listed.get(w, 0) for w, n in words.items())
        return s / (s * s + 15) ** 0.5

    assert {k: v[0] for k, v in got.items()} == {k: pytest.approx(brute(t, s)) for k, t, s in rows}
    assert {k: v[1] for k, v in got.items()} == {1: "Positive", 2: "Neutral", 3: "Negative", 4: "Positive"}


def _notes(spark, companies=(), counts=(), inputs=(), sectors=(), warnings=()):
    make = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    found = news.data_quality(make(companies, "ticker int, refreshed boolean, method string, pledged double"), make(counts, "ticker int, counted int"), make(inputs, "place int, label string, priced boolean"), make(sectors, "sector string, band string"), make(warnings, "materiality_pct double"))
    return {r.topic: (r.level, r.note) for r in found.orderBy("place").collect()}


def test_data_quality(spark):
    assert _notes(spark) == {"Live prices": ("unknown", "refresh status not recorded this run.")}
    companies = [(i, i >= 3, "No Estimate" if i < 2 else None, 1.0 if i == 5 else None) for i in range(16)]
    inputs = [(i, f"in{9 - i}", None if i % 2 else False) for i in range(6)] + [(7, "oil", True)]
    got = _notes(spark, companies, [(1, 2), (2, 0), (3, None)], inputs, [("a", "material"), ("b", "severe"), ("c", "quiet"), ("d", None)], [(1.5,), (None,)])
    assert got == {
        "Live prices": ("fair", "13/16 holdings refreshed (81%)."), "News coverage": ("info", "1 of 3 holdings had attributable items."),
        "Estimates suppressed": ("fair", "2 of 16 holdings carry no target, because neither analyst coverage nor a usable fundamental base was available."),
        "Promoter pledging": ("info", "1 of 16 holdings disclosed a pledge figure; the rest are unread, not confirmed unpledged."), "Input costs": ("info", "1 input(s) priced; 2 sector(s) carrying a material move."),
        "Inputs not priced": ("poor", "in9, in8, in7, in6, and 2 more — treated as unmeasured, not as unchanged."), "Order sizing": ("info", "1 alert(s) measured against trailing revenue; the rest carried no attributable figure."),
    }


@pytest.mark.parametrize(("of", "level"), [((19, 20), "good"), ((4, 5), "fair"), ((79, 100), "poor")])
def test_freshness_levels(spark, of, level):
    assert _notes(spark, [(i, i < of[0], None, None) for i in range(of[1])])["Live prices"][0] == level
