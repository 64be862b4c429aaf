"""What a dashboard is given: capped feeds, warnings that call for a decision, what is new."""

import datetime
from collections import Counter

from pyspark.sql import functions as F

from marketlens.functions import coerce
from marketlens.operators import display

DAY = datetime.date(2026, 8, 20)


def test_capped(spark):
    rows = [(f, i, "x") for f, n in {"market_events": 50, "global_market_news": 50, "sebi_filings": 3, "steel": 70}.items() for i in range(n)] + [("market_events", None, "late"), (None, 1, "odd"), ("market_events", 0, "x")]
    got = display.capped(spark.createDataFrame(rows, "feed string, place int, title string")).collect()
    assert Counter(r.feed for r in got) == {"market_events": 40, "global_market_news": 20, "sebi_filings": 3, "steel": 70, None: 1}
    events = sorted((r.rank, r.place) for r in got if r.feed == "market_events")
    assert events == list(zip(range(1, 41), [0, 0, *range(1, 39)]))  # rows that repeat each have a place of their own
    assert {r.rank for r in got if r.feed in ("steel", None)} == {None}
    assert display.capped(spark.createDataFrame([], "feed string, place int")).collect() == []


def test_capped_feed_of_a_third_of_all_rows_is_cut_in_its_tasks(spark):
    rows = spark.range(30_000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, "market_events").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("feed"), F.col("id").alias("place"))
    plan = display.capped(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert display.capped(rows).where("feed = 'market_events'").agg(F.max("place")).first()[0] == 39 * 3


def test_capped_topics(spark):
    got = display.capped_topics(spark.createDataFrame([("A", i) for i in range(9)] + [("B", 1), (None, 2)], "ticker string, place int"))
    assert Counter(r.ticker for r in got.collect()) == {"A": 5, "B": 1, None: 1}


WARNINGS = [("A", "Pledge", "risk", "High", "ongoing"), ("B", "Pledge", "risk", "High", "ongoing"), ("A", "Pledge", "risk", "High", "ongoing"), ("", "Odd", None, None, "ongoing"), ("C", "Trend", "risk", "Low", "ongoing"), ("D", "Exit", "risk", "Critical", "ongoing"), ("E", "Trend", "risk", "Low", "new"), ("F", "Exit", "risk", "High", "escalated"), ("G", "Trend", "risk", "Low", None)]


# fixed values: rows in order of gravity and number, each ticker once
def test_standing_and_actionable(spark):
    rows = spark.createDataFrame(WARNINGS, "ticker string, category string, direction string, severity string, status string")
    got = [(r.category, r.severity, r.n, r.tickers) for r in display.in_standing_order(display.standing(rows)).collect()]
    assert got == [("Exit", "Critical", 1, ["D"]), ("Pledge", "High", 3, ["A", "B"]), ("Trend", "Low", 1, ["C"]), ("Odd", None, 1, [])]
    assert sorted(r.ticker for r in display.actionable(rows).collect()) == ["E", "F"]


def _new(spark, revisions=(), theses=(), ledger=(), candidates=(), entrants=(), warnings=()):
    make = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    found = display.whats_new(
        make(revisions, "ticker string, direction string, target_change_pct double"), make(theses, "ticker string, place int, health string, reason string"), make(ledger, "ticker string, place int, action string, price double, date date, outcome string"),
        make(candidates, "place int, ticker string, name string, status string, action string, replaced string"), make(entrants, "place int, sector string, challenger string, incumbents array<string>"), make(warnings, "ticker string, category string, severity string, signal string"),
    )
    return [(r.group, r.level, r.place, r.text) for r in found.orderBy("seat", "place").collect()]


CANDIDATES = [(1, "NEW", "New", "Watchlisted", "added", None), (2, "ROT", "Rot", "Watchlisted", "rotated_in", "OLD"), (3, "HELD", "Held", "Watchlisted", None, None), *[(i, None if i == 4 else f"D{i}", f"Late {i}", "Deferred", None, None) for i in range(4, 12)]]


def test_whats_new(spark):
    revisions = [("A", "up", 12.5), ("B", "down", -40.0), ("C", "up", 100.0), *[(f"Z{i}", "up", 3.25) for i in range(9)], ("N", "up", None)]
    ledger = [("L1", 1, "rotated_in", 101.5, DAY, None), ("L2", 2, None, None, None, "Underperforming"), (None, 0, "added", 1.0, DAY, None), ("", 0, "added", 1.0, DAY, None)]
    got = _new(
        spark, revisions, [("A", 2, "Broken", "pledge"), ("B", 1, "Broken", None), ("C", 0, "Intact", "x")], ledger, CANDIDATES,
        [(2, "steel", "Omega", ["X", "Y"]), (1, "solar", "Zeta", []), (1, "solar", "Alpha", ["X"]), (3, "s", "P", ["X"]), (4, "s", "Q", ["X"])], [("B", "Exit", "Critical", "sold 3%"), ("A", "Exit", "High", "x"), ("A", "Trend", "Critical", None)],
    )
    assert got == [
        ("Analyst targets moved", "info", 1, "C consensus target raised +100%"), ("Analyst targets moved", "info", 2, "B consensus target cut -40%"), ("Analyst targets moved", "info", 3, "A consensus target raised +12.5%"),
        *[("Analyst targets moved", "info", 4 + i, f"Z{i} consensus target raised +3.25%") for i in range(3)],
        ("Theses broken", "danger", 1, "B thesis broken"), ("Theses broken", "danger", 2, "A thesis broken pledge"),
        ("Watchlist changes", "success", 1, "L1 rotated in at 101.5 2026-08-20 — not yet scored"), ("Watchlist changes", "success", 2, "L2 changed — Underperforming"),
        *[("Deferred candidates", "info", i - 3, f"{'Late 4' if i == 4 else f'D{i}'} held for a later run") for i in range(4, 9)],
        ("New entrants", "warning", 1, "Alpha entering solar — pressures X"), ("New entrants", "warning", 2, "Zeta entering solar — pressures"), ("New entrants", "warning", 3, "Omega entering steel — pressures X, Y"), ("New entrants", "warning", 4, "P entering s — pressures X"),
        ("Critical alerts", "danger", 1, "A Trend"), ("Critical alerts", "danger", 2, "B Exit sold 3%"),
    ]


def test_whats_new_without_a_ledger_tells_of_candidates_that_joined(spark):
    got = _new(spark, candidates=CANDIDATES[:3], ledger=[(None, 0, "added", 1.0, DAY, None)])
    assert got == [("Watchlist changes", "success", 1, "NEW Added"), ("Watchlist changes", "success", 2, "ROT Rotated in for OLD")]


def test_whats_new_works_out_each_group_by_itself(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    found = display.whats_new(
        make([("A", "up", 12.5)], "ticker string, direction string, target_change_pct double"), make([], "ticker string, place int, health string, reason string"), make([], "ticker string, place int, action string, price double, date date, outcome string"),
        make([], "place int, ticker string, name string, status string, action string, replaced string"), make([], "place int, sector string, challenger string, incumbents array<string>"), make([], "ticker string, category string, severity string, signal string"),
    )
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 1


def test_a_quiet_run_has_no_news(spark):
    assert _new(spark) == []


def test_fixed_rounds_like_exact_binary_values(spark):
    import random
    from decimal import ROUND_HALF_EVEN, Decimal

    dice = random.Random(5)
    xs = [0.0, -0.0, 2.675, 1.005, 0.125, 0.375, -0.125, 0.005, 0.015, -0.001, -0.004, 0.05, 0.15, 0.25, 0.35, 0.45, 999.995, 1e-300, 5e-324, 9.995, 99.95, 1e11 + 0.125, 999999999999.985]
    xs += [dice.randrange(10**7) / 1000 for _ in range(3000)] + [dice.randrange(-(10**5), 10**5) / 8 for _ in range(1000)] + [dice.uniform(-1e6, 1e6) for _ in range(1000)] + [dice.uniform(0, 1e12) for _ in range(1000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", coerce.fixed(F.col("x"), 2).alias("two"), coerce.fixed(F.col("x"), 1).alias("one")).collect()
    for r in got:
        assert (r.two, r.one) == (f"{r.x:.2f}", f"{r.x:.1f}"), r.x
        assert Decimal(r.two) == Decimal(r.x).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(coerce.fixed(F.col("x"), 2).alias("y"), coerce.wire_percent(F.col("x")).alias("z")).collect()
    assert {(r.y, r.z) for r in odd} == {(None, None)}
    assert spark.createDataFrame([(0.0,), (0.01,), (-3.25,)], "x double").select(coerce.wire_percent(F.col("x")).alias("y")).collect() == [("0.0%",), ("+0.0%",), ("-3.2%",)]


# fixed values: stamps and how they are shown
STAMPS = [
    ("14-Aug-2026 17:30:00", "14 Aug 2026", "14 Aug 2026"), ("14-Aug-2026", "14 Aug 2026", "14-Aug-2026"), ("2026-08-14 17:30:00", "14 Aug 2026", "14 Aug 2026"), ("2026-08-14", "14 Aug 2026", "14 Aug 2026"),
    ("2026-08-14T15:41:54.000Z", "2026-08-14T15:41:54.000Z", "14 Aug 2026"), ("14 Aug 2026 15:41:54", "14 Aug 2026 15:41:54", "14 Aug 2026"), ("14/08/2026", "14/08/2026", "14 Aug 2026"), ("4-aug-2026", "04 Aug 2026", "4-aug-2026"),
    ("31-Feb-2026", "31-Feb-2026", "31-Feb-2026"), ("soon", "soon", "soon"), ("", "", ""), (None, "", ""),
]


def test_stamps(spark):
    got = spark.createDataFrame([(t,) for t, _, _ in STAMPS], "t string").select("t", coerce.nse_stamp(F.col("t")).alias("nse"), coerce.bse_stamp(F.col("t")).alias("bse")).collect()
    assert [tuple(r) for r in got] == STAMPS
