"""Themes, calendars, reasons and orders of a briefing."""

import datetime

from pyspark.sql import functions as F

from marketlens.operators import views


def values(spark, column, items):
    return [r[0] for r in spark.createDataFrame(list(enumerate(items)), "i int, x string").orderBy("i").select(column).collect()]


def test_funds(spark):
    names = ["Tata Infrastructure Fund - Direct Plan - Growth", "Tata Infrastructure Fund-Quarterly IDCW", "Tata Infrastructure Fund (Regular) Option", "Plain Fund", "Make In India Fund", "Digital Defence", None]
    assert values(spark, views.base_name(F.col("x")), names)[:5] == ["tata infrastructure fund"] * 3 + ["plain fund", "make in india fund"]
    assert values(spark, views.theme(F.col("x")), names) == ["Logistics & Infra"] * 3 + [None, "Manufacturing & PLI", "Semiconductors & Tech", None]


def test_calendar(spark):
    days = ["2026-01-26", "2026-01-27", "2026-01-25", "2026-12-25"]
    assert values(spark, views.is_trading_day(F.to_date("x")), days) == [False, True, False, False]


def test_reasons(spark):
    rows = spark.createDataFrame([(1, -3.96, -1.0, -1.0, 8), (2, 5.0, -2.7, -1.0, 8), (3, 5.0, 2.0, -1.0, 8), (4, None, None, None, 3), (5, 5.0, 1.0, 1.0, 8), (6, None, None, None, None)], "i int, eps double, opm double, q double, n int")
    got = [r[0].split(" (")[0] for r in rows.orderBy("i").select(views.suppression_reason(F.col("eps"), F.col("opm"), F.col("q"), F.col("n"))).collect()]
    assert got == ["Negative trailing earnings", "Operating loss in the latest quarter", "Latest quarter swung to a loss", "Insufficient quarterly history for a trailing year", "Insufficient data for an honest estimate", "Insufficient quarterly history for a trailing year"]


def test_catalysts_and_alias(spark):
    companies = spark.createDataFrame([("A", "Acme"), ("B", "Beta")], "ticker string, name string")
    events = spark.createDataFrame([("acme", "Filing", "x"), ("a", "Filing", "x"), ("a", "Launch", "y"), (None, "Filing", "z")], "company string, kind string, title string")
    assert [(r["ticker"], r["n_events"], r["first_label"]) for r in views.policy_catalysts(companies, events).collect()] == [("A", 2, "Filing: x")]
    sectors = spark.createDataFrame([("clean_energy", "Clean Energy", None)], "key string, label string, name string")
    assert views.by_alias(spark.createDataFrame([("CLEAN ENERGY",), ("Clean_Energy",), ("other",), (None,)], "sector string"), sectors).count() == 2


def test_orders(spark):
    shocks = spark.createDataFrame([("b", 13.0, "severe"), ("a", -6.0, "material"), ("c", 1.0, "quiet")], "sector string, score double, band string")
    assert [(r["sector"], r["severity"], r["direction"]) for r in views.input_cost_warnings(shocks).collect()] == [("b", "High", "risk"), ("a", "Medium", "opportunity")]
    health = spark.createDataFrame([(2, "Intact"), (1, "Intact"), (9, "Broken"), (5, "Weakening")], "ticker int, health string")
    assert [r["ticker"] for r in views.in_thesis_order(health).collect()] == [9, 5, 1, 2]
    assert values(spark, views.rating_score(F.col("x")), ["Strong Buy", "Buy", "Hold", "Sell", "Odd", None]) == [4, 3, 2, 1, 0, 0]
    assert datetime.date(2026, 1, 26).isoformat() in views.HOLIDAYS
