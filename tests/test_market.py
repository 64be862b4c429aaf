"""Every market query against DuckDB, and operators on small cases."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from marketlens.functions import coerce
from marketlens.operators import rules, series, sets
from marketlens.plans import catalogue, research  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    theirs = con.sql(catalogue.SQL[name])
    assert sorted(theirs.columns) == columns
    want = sorted(tuple(map(shown, r)) for r in theirs.select(*columns).fetchall())
    assert sorted(tuple(map(shown, r)) for r in got.select(*columns).collect()) == want


def values(spark, column, items, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").orderBy("i").select(column).collect()]


def test_numbers(spark):
    assert values(spark, coerce.to_number(F.col("x")), [" +1,840.5% ", "15%", "-5%", "N/A", "", None]) == [1840.5, 15.0, -5.0, None, None, None]


def test_days(spark):
    day = datetime.date(2026, 7, 9)
    assert values(spark, coerce.to_day(F.col("x")), ["2026-07-09", "Thu, 09 Jul 2026 10:58:52 GMT", "09-07-2026", "soon", None]) == [day, day, day, None, None]


def test_bands(spark):
    assert values(spark, coerce.liquidity(F.col("x")), [0.5, 1.0, 24.9, 25.0, None, float("nan")], "double") == ["illiquid", "thin", "adequate", "liquid", "unknown", "unknown"]
    assert values(spark, coerce.move(F.col("x")), [20.0, -7.0, 1.0, None], "double") == ["severe", "material", "quiet", "unmeasured"]


def test_clauses(spark):
    assert values(spark, coerce.clauses(F.col("x")), ["a; b - c | d", "", None]) == [["a", "b", "c", "d"], [], None]
    assert values(spark, coerce.clauses(F.col("x")), [" ; "]) == [[" ; "]]


def quarters(spark, rows):
    return spark.createDataFrame([(s, t, i, float(v)) for s, t, vs in rows for i, v in enumerate(vs)], "sector string, ticker int, period int, sales double")


def test_growth(spark):
    one = series.holding_growth(quarters(spark, [("s", 1, [80, 85, 90, 95, 100, 110, 120, 130])])).first()
    assert (one["quarters"], round(one["yoy"], 1)) == (8, 36.8)
    two = series.holding_growth(quarters(spark, [("s", 1, [4348, 5976, 6957, 13700, 4819, 6629, 7699, 13942])])).first()
    assert (round(two["ttm"], 1), two["ttm_quality"]) == (6.8, "ok")


def test_share(spark):
    got = {r["ticker"]: r for r in series.market_share(quarters(spark, [("s", 1, [100] * 5), ("s", 2, [100, 150, 200, 250, 300])])).collect()}
    assert (got[1]["share"], got[1]["change"], got[2]["change"]) == (25.0, -25.0, 25.0)


def test_status(spark):
    kind = "ticker int, category string, severity string"
    now = spark.createDataFrame([(1, "a", "High"), (1, "b", "Low"), (2, "a", "Low")], kind)
    before = spark.createDataFrame([(1, "a", "Medium"), (1, "b", "High")], kind)
    assert {(r["ticker"], r["category"]): r["status"] for r in rules.with_status(now, before).collect()} == {(1, "a"): "escalated", (1, "b"): "ongoing", (2, "a"): "new"}


def test_merge_and_caps(spark):
    new, old = spark.createDataFrame([(1, 1, "n")], "k int, at int, v string"), spark.createDataFrame([(1, 0, "o"), (2, 0, "o")], "k int, at int, v string")
    assert sorted((r["k"], r["v"]) for r in sets.history_merge(new, old, ["k"], ["at"]).collect()) == [(1, "n"), (2, "o")]
    points = spark.createDataFrame([(1, i, 3) for i in range(5)], "k int, at int, p int")
    assert tuple(sets.capped_total(points, ["k"], ["at"], "p", 8).first()) == (1, 3, 8)


# fixed values: inputs and results that other implementations agree on


def one(spark, kind, *values):
    return spark.createDataFrame([values], kind)


def test_pledges(spark):
    kind = "ticker int, pledged double, pledged_change double, above_low double"
    cases = [(None, None, None, "not_disclosed", None), (0.0, 1.0, 1.0, "none", None), (45.0, None, None, "severe", "Critical"), (20.0, 0.5, 90.0, "high", "Critical"), (20.0, 0.0, 20.0, "high", "Critical"), (20.0, 0.4, 21.0, "high", "High")]
    cases += [(5.0, 0.6, 10.0, "notable", "High"), (5.0, 0.6, 50.0, "notable", "Medium"), (2.0, 0.6, None, "notable", "Medium"), (2.0, 0.1, 5.0, "none", None)]
    got = {r["ticker"]: (r["status"], r["severity"]) for r in rules.pledge_verdict(spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], kind)).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3:] for c in cases]


def test_graham(spark):
    kind = "eps double, ttm double, q_eps double, q_opm double, price double"
    value = lambda *x: rules.graham(one(spark, kind, *x)).first()["graham_value"]
    assert value(10.0, 10.0, 2.0, 5.0, 100.0) == round(10 * (8.5 + 20) * 4.4 / 7, 1)
    assert value(10.0, None, None, None, 100.0) == round(10 * (8.5 + 12) * 4.4 / 7, 1)
    assert value(10.0, 90.0, 2.0, 5.0, 100.0) == round(10 * (8.5 + 30) * 4.4 / 7, 1)
    assert value(10.0, -5.0, -0.1, 5.0, 100.0) == value(10.0, 5.0, 2.0, -2.7, 100.0) == value(-3.96, 5.0, 2.0, 2.0, 100.0) == 0.0


def test_decisions(spark):
    day = datetime.date
    rows = [(day(2026, 1, 1), 100.0, 140.0, 120.0), (day(2026, 1, 1), 100.0, 140.0, 119.0), (day(2026, 1, 1), 100.0, 90.0, 130.0), (day(2026, 1, 1), 100.0, 140.0, None), (day(2026, 2, 20), 100.0, 140.0, 150.0), (day(2026, 1, 1), 0.0, 140.0, 150.0)]
    ledger = spark.createDataFrame([(i, day(2026, 3, 1), *r) for i, r in enumerate(rows)], "id int, today date, date date, price_at_decision double, target_at_decision double, price double")
    assert [r["outcome"] for r in rules.scored_decisions(ledger).orderBy("id").collect()] == ["Thesis Playing Out", "Underperforming", "Underperforming", "Left Watchlist (unscored)", "pending", "Underperforming"]


def test_margin_slide_and_status(spark):
    wide = {**dict.fromkeys("promoter_change fii_change dii_change qoq current_ratio debt_equity opm_change day_change volume_surge price_to_ma margin_1 margin_2 margin_3".split()), "ticker": 1, "sector": "s"}
    kind = ", ".join(f"{c} {'int' if c == 'ticker' else 'string' if c == 'sector' else 'double'}" for c in wide)
    found = lambda **x: sorted((r["category"], r["severity"]) for r in rules.warnings(spark.createDataFrame([tuple((wide | x).values())], kind)).collect())
    assert found() == []
    assert found(opm_change=-3.0) == [("Margin Compression", "Medium")] and found(opm_change=-6.0, margin_1=1.0, margin_2=2.0, margin_3=3.0) == [("Margin Compression", "Critical")]
    assert found(opm_change=-3.0, margin_1=1.0, margin_2=2.0, margin_3=2.0) == [("Margin Compression", "Medium")]
    assert found(debt_equity=1.0) == [("Elevated Leverage", "Medium")] and found(debt_equity=1.4) == [("High Leverage", "High")] and found(promoter_change=-2.5, fii_change=-3.5, qoq=-8.0, current_ratio=0.8, day_change=-9.0) == [("FII Outflow", "Critical"), ("Liquidity Stress", "High"), ("Price Breakdown", "Critical"), ("Promoter Exit", "Critical"), ("Revenue Contraction", "High")]
    assert found(fii_change=0.1) == [("Institutional Buying", "Medium")] and found(fii_change=0.1, dii_change=0.1) == [("Institutional Accumulation", "High")]


def test_thesis(spark):
    companies = spark.createDataFrame([(t, "s") for t in range(5)], "ticker int, sector string")
    found = spark.createDataFrame([(1, "risk", "High"), (2, "risk", "High"), (2, "risk", "High"), (3, "risk", "Low"), (3, "risk", "Medium"), (4, "opportunity", "Critical")], "ticker int, direction string, severity string")
    revised = spark.createDataFrame([(0, "down", -10.0), (1, "down", -12.0), (3, "down", -9.9), (4, "up", 20.0)], "ticker int, direction string, target_change_pct double")
    assert [r["health"] for r in rules.thesis_health(companies, found, revised).orderBy("ticker").collect()] == ["Weakening", "Broken", "Broken", "Weakening", "Intact"]


def test_traded_value(spark):
    rows = spark.createDataFrame([("a", 20.0, 1e5), ("b", 4000.0, 1e5), ("c", 100.0, 1e5), ("c", 200.0, 1e4), ("d", None, 1e5), ("d", float("nan"), 1.0)], "k string, close double, volume double")
    got = {r["k"]: (r["advt_cr"], r["liquidity_band"], r["days_to_exit_1cr"]) for r in series.traded_value(rows, "k").collect()}
    assert got == {"a": (0.2, "illiquid", 25.0), "b": (40.0, "liquid", 0.1), "c": (0.6, "illiquid", 8.3), "d": (None, "unknown", None)}


def test_stage_and_share(spark):
    stage = lambda *vs: series.curve_stage(quarters(spark, [("s", i, v) for i, v in enumerate(vs)])).first()
    assert stage([100, 120, 150], [100, 120, 150])["stage"] == "Inflection / Steep Adoption" and stage([100, 150, 180], [100, 150, 180])["stage"] == "Maturing"
    assert stage([100, 101, 106], [100, 101, 106])["stage"] == "Pre-Inflection (building)" and stage([100, 99, 98], [100, 99, 98])["stage"] == "Late-Cycle / Contracting" and stage([100, 105, 110], [100, 105, 110])["stage"] == "Steady State"
    assert stage([100, 120], [100, 120])["acceleration_pp"] == 0.0 and stage([100, 120], [100]) is None
    short = series.market_share(quarters(spark, [("s", 1, [100, 100, 100]), ("s", 2, [100, 100, 200, 100, 300]), ("s", 3, [1, 0, 5]), ("t", 4, [1, 2])])).collect()
    assert {r["ticker"]: (r["lookback_quarters"], r["peer_count"], round(r["share_before"], 1)) for r in short} == {1: (2, 2, 33.3), 2: (2, 2, 66.7)}


def test_valuation_labels(spark):
    rows = spark.createDataFrame([(1, "s", 10.0), (2, "s", 20.0), (3, "s", 30.0), (4, "s", 600.0), (5, "s", 20.4), (6, "t", 300.0), (7, "s", -1.0)], "ticker int, sector string, pe double")
    got = {r["ticker"]: (r["industry_pe"], r["pe_vs_peers"]) for r in series.sector_valuation(rows).collect()}
    assert got == {1: (20.2, "50% below peers"), 2: (20.2, "In line with peers"), 3: (20.2, "49% above peers"), 4: (20.2, "Extreme outlier (excluded from peer stats)"), 5: (20.2, "In line with peers"), 6: (300.0, "Extreme outlier (excluded from peer stats)")}


def test_first_seen_keeps_all_keys(spark):
    from marketlens.streaming import incremental

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "k int, v string")
    assert incremental.first_seen(rows, ["k", "v"]).count() == 2
