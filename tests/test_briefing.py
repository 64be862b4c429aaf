"""Sector blocks, the day's row, and the cut that fits a size."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from marketlens.operators import briefing

DAY = datetime.date(2026, 8, 20)
WARNING = "ticker string, sector string, category string, direction string, severity string, status string"
ROWS = [
    ("ACME", "a", "Promoter Exit", "risk", "Critical", "new"), ("ACME", "a", "High Leverage", "risk", "High", "ongoing"), ("BETA", "a", "Momentum Breakout", "opportunity", "Medium", "escalated"), ("CORE", "b", "Below Trend", "risk", "Low", "ongoing"),
    ("DOT", "c", "Below Trend", "risk", "Odd", "new"), ("DOT", "d", "Below Trend", "risk", "Low", None),
]


def _inputs(spark, empty=False):
    make = lambda rows, kind: spark.createDataFrame([] if empty else rows, kind)
    titles = [("a", 1, "Weather today", DAY), ("a", 2, "BETA signs MoU", DAY), ("a", 3, "Policy talk of an order", DAY), ("a", 4, "Cabinet clears scheme", DAY), ("a", 5, "acme slips", DAY), ("a", 6, "Bags contract", datetime.date(2026, 8, 1)), ("b", 7, "Weather", None), ("b", 8, "", DAY), ("b", 9, None, DAY)]
    return (
        make(ROWS, WARNING), make(titles, "sector string, id int, title string, day date"), make([("a", "ACME", "x"), ("a", "BETA", "No Estimate"), ("a", "ZED", "x"), ("a", "AAA", "x"), ("b", "CORE", "No Estimate"), ("c", "DOT", "x"), ("d", "DOT", "x"), ("e", "E", "x")], "sector string, ticker string, method string"),
        make([("ZED", 3), ("CORE", 1)], "ticker string, counted int"), make([("a", "Omega", 5), ("a", None, 9)], "sector string, challenger string, id int"), make([("a", "Peer", "P", 12.34, 1), ("b", "", "Q", None, 1), ("b", None, None, -3.0, 2), ("b", "late", "R", 1.0, 3)], "sector string, name string, ticker string, sales_var double, place int"),
    )


def test_sector_blocks(spark):
    got = briefing.in_block_order(briefing.sector_blocks(*_inputs(spark))).collect()
    # by change, then by news, then by name; d has neither, as an unknown status is a standing one
    assert [(r["sector"], r["delta"], r["n_new"], r["n_escalated"]) for r in got] == [("a", 6, 1, 1), ("c", 1, 1, 0), ("b", 0, 0, 0)]
    a, c, b = got
    # linked to a critical warning, orders by day, policy; ties by id
    assert [(x["id"], x["kind"]) for x in a["news"]] == [(5, "linked_to_critical"), (6, "order_win"), (3, "order_win"), (4, "policy")]
    assert [tuple(x) for x in a["focus"]] == [("ACME", 4, "Promoter Exit", 0), ("BETA", 2, "Momentum Breakout", 0), ("ZED", 0, "No signal this cycle", 3)]
    assert [tuple(x) for x in a["threats"]] == [("Omega", "new entrant"), ("Unnamed", "new entrant")] and a["suppressed"] == ["BETA"] and a["stance"] == "1 new, 1 escalated"
    assert [tuple(x) for x in b["threats"]] == [("Q", "unlisted entrant"), ("Unnamed", "-3.0% revenue growth")] and b["stance"] == "No change this cycle; carrying news only"
    assert [x["id"] for x in b["news"]] == [7] and c["news"] is None and c["focus"][0]["ticker"] == "DOT"
    assert briefing.sector_blocks(*_inputs(spark, empty=True)).count() == 0


@pytest.mark.parametrize(("budget", "tier", "sectors"), [(10**6, "full", 3), (0, "minimal", 2)])
def test_fitted(spark, budget, tier, sectors):
    rows = briefing.fitted(briefing.sector_blocks(*_inputs(spark)), budget).orderBy("place").collect()
    assert [r["tier"] for r in rows] == [tier] * sectors and [json.loads(r["block"])["sector"] for r in rows] == ["a", "c", "b"][:sectors]
    first = json.loads(rows[0]["block"])
    _, _, stocks, news = next(t for t in briefing.LADDER if t[0] == tier)
    assert (len(first["focus"]), len(first["news"])) == (min(3, stocks), min(4, news))


def test_fitted_takes_the_first_tier_that_fits(spark):
    blocks = briefing.sector_blocks(*_inputs(spark))
    size = {}
    for tier in briefing.LADDER:
        size[tier[0]] = sum(len(r["block"].encode()) for r in briefing.fitted(blocks, 10**9, (tier,)).collect())
    assert size["full"] > size["compact"] > size["minimal"]
    for budget, want in ((size["full"], "full"), (size["full"] - 1, "compact"), (size["compact"], "compact"), (size["compact"] - 1, "minimal")):
        assert {r["tier"] for r in briefing.fitted(blocks, budget).collect()} == {want}
    assert briefing.fitted(blocks.limit(0)).count() == 0


def test_daily_summary(spark):
    company = "ticker string, price double, has_figures boolean, ttm double, method string"
    companies = spark.createDataFrame([("ACME", 5.0, True, 1.0, "x"), ("BETA", 0.0, True, None, "No Estimate"), ("CORE", 3.0, False, None, "x")], company)
    theses = spark.createDataFrame([("ACME", "Broken"), ("BETA", "Intact")], "ticker string, health string")
    warnings = spark.createDataFrame(ROWS, WARNING)
    got = briefing.daily_summary(warnings, companies, theses).first().asDict()
    # 2 of 3 priced, 2 of 3 with figures, 1 of 3 with growth
    assert got == {"day_type": "normal", "completeness": 56, "critical_total": 1, "escalated_total": 1, "opportunities_total": 1, "new_total": 2, "ongoing_total": 3, "ongoing_groups": 2, "broken_theses": 1, "suppressed": 1, "hot_sectors": "a 2; c 1"}
    quiet = briefing.daily_summary(warnings.where("status = 'ongoing'"), companies, theses).first()
    assert (quiet["day_type"], quiet["hot_sectors"]) == ("quiet", "")
    poor = briefing.daily_summary(warnings, companies.withColumn("price", F.lit(0.0)), theses).first()
    assert poor["day_type"] == "degraded"
    assert briefing.daily_summary(warnings.limit(0), companies.limit(0), theses.limit(0)).first()["completeness"] == 0
