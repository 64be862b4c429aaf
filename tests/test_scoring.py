"""Points of news, whole-company scores and warnings sized by their own headlines."""

import datetime

from pyspark.sql import functions as F

from marketlens.operators import attribution, rules

TODAY = datetime.date(2026, 8, 20)


def _day(n):
    return TODAY - datetime.timedelta(days=n)


def test_news_points(spark):
    """Equal headlines count once, old ones not at all, sizes weigh, and the cap ends the count."""
    event = "ticker string, place int, title string, type string, day date, weight double"
    rows = [
        ("A", 1, "PLI approval for A", "", _day(0), 1.0), ("A", 2, "pli approval, for A!", "", _day(0), 1.0), ("A", 3, "MoU signed", "mou", _day(0), 1.0), ("A", 4, "never reached", "launch", _day(0), 1.0),
        ("B", 1, "Old launch", "launch", _day(121), 1.0), ("B", 2, "old launch.", "launch", _day(0), 1.0), ("B", 3, "Undated launch", "launch", None, 0.25), ("B", 4, "Notice", None, _day(120), 0.5),
        ("C", 1, "!!", "launch", _day(0), 1.0), ("C", 2, None, "launch", _day(0), 1.0), ("D", 1, "Agreement", "Agreement", _day(0), 0.5), ("D", 2, "x", "product_launch", _day(0), 0.5), ("E", 1, "a", "PLI", _day(0), 1.5), ("F", 1, "future", "x", _day(-5), 0.25),
    ]
    rows += [("G", i, f"small deal {i}", "launch", _day(0), 0.25) for i in range(40)]
    got = {r["ticker"]: (r["n_counted"], r["momentum"]) for r in rules.news_points(spark.createDataFrame(rows, event), F.lit(TODAY)).collect()}
    # 2.75 and 3.5 round to even neighbours, 7.5 to eight
    assert got == {"A": (2, 8), "B": (2, 3), "D": (2, 4), "E": (1, 8), "F": (1, 1), "G": (11, 8)}


COMPANY = {
    "ticker": "A", "ttm": 20.0, "opm_change": 2.5, "debt_equity": 0.25, "current_ratio": 2.0, "roce": 22.0, "roe": 16.0, "promoter_change": 0.0, "fii_change": 1.5, "dii_change": 0.5, "debt": 10.0, "value": 1000.0, "net_assets": 50.0, "price": 100.0,
    "eps": 10.0, "q_eps": 1.0, "q_opm": 1.0, "pe": 10.0, "dividend": 1.0, "revenue_last": 2.0, "revenue_before": 1.0, "qoq": 20.0, "liquidity_band": "liquid", "advt_cr": 31.5, "days_to_exit_1cr": 0.2, "momentum": 4,
}
KIND = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int' if k == 'momentum' else 'double'}" for k, v in COMPANY.items())


def _scored(spark, **other):
    return rules.aggregate_score(spark.createDataFrame([tuple((COMPANY | other).values())], KIND)).first()


def test_score(spark):
    r = _scored(spark)
    assert (r["fundamental_score"], r["momentum_score"], r["overall_score"], r["confidence"], r["recommendation"]) == (14, 4, 18, "High", "Strong Buy Candidate")
    assert r["risks"] == [] and r["reasons"] == [
        "Strong revenue growth (TTM +20.0%)", "Operating Margin Expansion (+2.5%)", "Low Debt to Equity (0.25)", "Strong Liquidity (Current Ratio: 2.0)", "High Return on Capital (ROCE: 22.0%)", "High Return on Equity (ROE: 16.0%)",
        "Liquid (Rs 32 Cr traded daily)", "FII Accumulation (+1.5%)", "DII Accumulation (+0.5%)", "Wide Economic Moat (Sustained Margin Expansion)", "Trading below Graham Intrinsic Value (242.0)",
    ]
    r = _scored(spark, ttm=-3.0, opm_change=-2.0, debt_equity=1.5, current_ratio=0.5, roce=None, roe=None, promoter_change=-1.0, fii_change=-2.0, dii_change=None, debt=100.0, eps=None, liquidity_band="thin", advt_cr=2.5, days_to_exit_1cr=2.5, momentum=None)
    assert r["risks"] == [
        "Revenue shrinking (TTM -3.0%)", "Operating margin contracted (-2.0pp)", "High Debt to Equity (1.5)", "Poor Liquidity (Current Ratio < 1)", "Thin: Rs 2.50 Cr traded daily, ~2 sessions to exit Rs 1 Cr",
        "Promoters cut their stake (-1.0%)", "FII Selling (-2.0%)", "Fails Current Ratio (< 2.0)", "Fails Debt Limit (Debt > Net Assets)",
    ]
    assert (r["fundamental_score"], r["momentum_score"], r["reasons"]) == (-14, 1, [])
    # turnover decides alone: the band costs points, an unknown turnover leaves its sentence out
    base = _scored(spark, liquidity_band="adequate")
    for band, points in (("illiquid", -2), ("thin", -1), ("unknown", 0), (None, 0)):
        r = _scored(spark, liquidity_band=band, advt_cr=None)
        assert r["fundamental_score"] == base["fundamental_score"] + points and r["risks"] == []
    nothing = {k: None for k in COMPANY if k not in ("ticker", "momentum")}
    r = _scored(spark, **nothing)
    assert (r["overall_score"], r["confidence"], r["recommendation"], r["risks"]) == (4, "Very Low", "Monitor (Data Unavailable)", ["No financial data available for scoring."])


def test_moat_without_debt(spark):
    """Unknown debt counts as none, unknown returns for nothing, a missing market value as one."""
    frame = spark.createDataFrame([(16.0, 16.0, None, 100.0), (None, None, None, None), (16.0, None, 1.0, None), (16.0, 15.0, 40.0, 100.0)], "roce double, roe double, debt double, value double")
    assert [r[0] for r in frame.select(rules.moat_points()).collect()] == [3, 1, 1, 1]


def test_valuation_stretch(spark):
    frame = spark.createDataFrame([(1, "s", ["x"]), (2, "s", []), (3, "s", None)], "ticker int, sector string, alerts array<string>")
    only = tuple(r for r in rules.RULES if r.levels[0][1] == "Valuation Stretch")
    assert [tuple(r) for r in rules.warnings(frame, only).collect()] == [(1, "s", "Valuation Stretch", "risk", "Medium")]


def test_sized_warnings(spark):
    """Each headline is measured by itself; the largest share of revenue stands for the warning."""
    source = "ticker string, category string, direction string, severity string, sources array<struct<kind:string,title:string>>"
    win, small = "Acme wins Rs 60 crore order", "Acme wins Rs 10 crore order"
    rows = [
        ("A", "x", "opportunity", "Medium", [(None, small), ("order_win", win), (None, "Acme stocks rally 5% on Rs 900 crore order")]), ("A", "y", "risk", "Low", [("order_win", win)]), ("A", "z", "opportunity", "Low", []), ("A", "v", "opportunity", "Low", None),
        ("B", "x", "opportunity", "High", [("order_win", win)]), ("A", "w", "opportunity", "Low", [(None, ""), (None, None), (None, small)]),
    ]
    got = rules.escalated(attribution.sized_warnings(spark.createDataFrame(rows, source), ["ticker", "category"], spark.createDataFrame([("A", 1000.0)], "ticker string, revenue double")))
    assert {(r["ticker"], r["category"]): (r["materiality_pct"], r["materiality_band"], r["materiality_basis"], r["severity"]) for r in got.collect()} == {
        ("A", "x"): (6.0, "material", win, "High"), ("A", "y"): (6.0, "material", win, "Low"), ("A", "z"): (None, None, None, "Low"), ("A", "v"): (None, None, None, "Low"), ("B", "x"): (None, None, None, "High"), ("A", "w"): (1.0, "immaterial", small, "Low"),
    }
