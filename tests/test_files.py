"""Scans of run files and extraction of figures from fragments."""

import json

from pyspark.sql import functions as F

from marketlens.functions import extract as E
from marketlens.sources import files


def test_scans(spark, tmp_path):
    path = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    rows = [tuple(r)[:3] + (r["price"], r["growth_pct"]) for r in files.watchlist(spark, path("w.json", json.dumps({"s": [{"ticker": "A", "price": "1,840.00", "growth_pct": "+23.0%"}, {"ticker": "B", "price": "N/A"}]}))).orderBy("ord").collect()]
    assert rows == [("s", 0, "A", 1840.0, 23.0), ("s", 1, "B", None, None)]
    seed = {"t": [{"ticker": "C"}]}
    for at in (path("bad.json", "{not json"), str(tmp_path / "none.json")):
        assert [(r["sector"], r["ticker"]) for r in files.watchlist(spark, at, seed).collect()] == [("t", "C")]
        assert files.watchlist(spark, at).count() == files.entity_graph(spark, at).count() == files.ledger(spark, at).count() == files.isin_master(spark, at).count() == 0
    edges = {"edges": [{"src": "a", "dst": "b", "type": "partner"}, {"src": "", "dst": "b", "type": "partner"}, {"src": "a", "dst": "b", "type": "odd"}]}
    assert [(r["src"], r["type"]) for r in files.entity_graph(spark, path("g.json", json.dumps(edges))).collect()] == [("a", "partner")]
    assert [r["ticker"] for r in files.ledger(spark, path("l.json", '[{"date": "2026-01-02", "ticker": "A"}]')).collect()] == ["A"] and files.ledger(spark, path("o.json", '{"a": 1}')).count() == 0
    assert [tuple(r) for r in files.isin_master(spark, path("i.json", '{"abc": "INE000A01010", "x": "US0000000000", "y": null}')).collect()] == [("ABC", "INE000A01010")]
    listed = "SYMBOL,NAME OF COMPANY, SERIES, ISIN NUMBER, FACE VALUE\nabc,Abc Ltd,EQ, INE000A01010,10\nxyz,Xyz,EQ,BAD,1\n"
    assert [tuple(r) for r in files.equity_csv(spark, path("e.csv", listed)).collect()] == [("ABC", "INE000A01010")]
    folder = str(tmp_path / "run")
    assert files.previous_run(spark, folder, "k int, v string").count() == 0
    files.write_run(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), folder)
    files.write_run(spark.createDataFrame([(3, "c")], "k int, v string"), folder)
    assert [tuple(r) for r in files.previous_run(spark, folder, "k int, v string").collect()] == [(3, "c")]


PAGE = """<section id="quarters"><table><tr><th></th><th>Mar</th></tr><tr><td><button>Sales&nbsp;+</button></td><td>1,200</td><td></td><td>-35%</td><td>n/a</td></tr><tr><td>OPM %</td><td>12%</td></tr></table></section><section id="other"><tr><td>Sales</td><td>9</td></tr></section>"""
PEERS = """<table><tr><th>S.No.</th><th>Name</th><th>Mar Cap Rs.Cr.</th><th>Sales Qtr Rs.Cr.</th><th>Qtr Sales Var %</th></tr><tr><td>1.</td><td><a href="/company/abc/consolidated/">Abc Ltd</a></td><td>1,234.5</td><td>600</td><td>-12.5</td></tr><tr><td>2.</td><td>No link</td><td>1</td></tr></table>"""


def test_extraction(spark):
    frame = spark.createDataFrame([(PAGE, PEERS)], "page string, peers string")
    value = lambda c: frame.select(c).first()[0]
    assert value(E.row_values(F.col("page"), "quarters", "^Sales")) == [1200.0, -35.0] and value(E.row_values(F.col("page"), "quarters", "OPM")) == [12.0]
    assert value(E.row_values(F.col("page"), "quarters", "Debt")) == [] and value(E.row_values(F.col("page"), "none", "Sales")) == []
    peer = value(E.peer_rows(F.col("peers")))
    assert len(peer) == 1 and (peer[0]["name"], peer[0]["ticker"], peer[0]["market_cap"], peer[0]["sales_qtr"], peer[0]["sales_var_pct"], peer[0]["roce"]) == ("Abc Ltd", "ABC", 1234.5, 600.0, -12.5, None)
    text = lambda t: F.lit(t).cast("string")
    assert value(E.isin(text("see INE002A01018 now"))) == "INE002A01018" and value(E.isin(text("INE002A0101"))) is None
    assert len(value(E.shortened(text("x" * 300)))) == 240 and value(E.shortened(text("short"))) == "short"
    assert value(E.feed_title(text("<b>A &amp; B</b> win - Paper"))) == "A & B win" and value(E.feed_source(text("A - B - Paper"), F.lit(None).cast("string"))) == "Paper"
    assert value(E.feed_summary(text("News here... Read more at x"))) == "News here"
    assert [value(E.exchange_day(text(t))) for t in ("14-Aug-2026 17:30:00", "2026-08-14", "soon", None)] == ["14 Aug 2026", "14 Aug 2026", "soon", ""]
    series = F.array(*[text(t) for t in ("1,000", "x", "5%")])
    assert value(E.numbers(series)) == [1000.0, 5.0] and value(E.numbers(series, strict=True)) == []
    assert value(E.last_of(F.array(*map(F.lit, (1.0, 2.0, 3.0))), 2)) == [2.0, 3.0] and value(E.last_of(F.array().cast("array<double>"), 2)) == [0.0, 0.0]
    assert value(E.owner_earnings(F.lit(50.0), F.lit(10.0), F.lit(20.0))) == 180.8


def test_filings(spark):
    raw = spark.createDataFrame([("abc", "", "x" * 300, None, None, "14-Aug-2026", "u"), ("zzz", "Other", "Note", "Steel", None, None, None), ("", "", "Note", None, None, None, None), ("q", None, " ", None, None, None, None)], "symbol string, sm_name string, attchmntText string, smIndustry string, industry string, an_dt string, attchmntFile string")
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("desc", "subject", "company", "date", "attachment")})
    got = {r["symbol"]: r for r in E.filings(raw, spark.createDataFrame([("ABC", "Abc Ltd", "steel")], "symbol string, name string, sector string")).collect()}
    assert set(got) == {"ABC", "ZZZ"} and (got["ABC"]["company"], got["ABC"]["industry"], got["ABC"]["date"], got["ABC"]["held"], len(got["ABC"]["filing"])) == ("Abc Ltd", "steel", "14 Aug 2026", True, 240)
    assert (got["ZZZ"]["company"], got["ZZZ"]["industry"], got["ZZZ"]["held"]) == ("Other", "Steel", False)
