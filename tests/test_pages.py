"""Figures of company pages and names of approval pages. Expected values are fixed inputs and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import pages as P

COMPANY = """<html><div class="card company-ratios"><ul id="top">
<li><span class="name"> Market Cap </span><span class="value">Rs <span class="number">1,84,000</span> Cr.</span></li>
<li><span class="name">Stock P/E</span><span class="number">24.5</span></li>
<li><span class="name">ROCE</span><span class="number">18.2</span><span>%</span></li>
<li><span class="name">ROE</span><span class="number">12</span></li>
<li><span class="name">Debt to equity</span><span class="number">n/a</span></li>
<li><span class="name">Face Value</span><span class="number">10</span></li></ul></div>
<section id="quarters"><table><tr><th></th><th>Mar</th></tr>
<tr><td><button>Sales&nbsp;+</button></td><td>100</td><td>-200</td><td>1,250.5</td></tr>
<tr><td>OPM %<td>12%<td>15.5%</tr><tr><td>EPS in Rs</td><td>1</td><td>2</td><td></td><td>3.25</td><td>x</td><td>4</td></tr></table></section>
<section id="shareholding"><table><tr><td>Promoters +</td><td>51.2%</td><td>50.1%</td></tr><tr><td>Pledged percentage</td><td>3.5</td></tr></table></section></html>"""


def test_company_figures(spark):
    rows = [("A", "clean_energy", COMPANY), ("B", "cybersecurity", None), ("C", None, ""), ("C", None, '<section id="cash-flow"><tr><td>Fixed assets purchased</td><td>5</td><td>-7</td></tr></section><section id="profit-loss"><tr><td>Research</td><td>9</td></tr>')]
    got = {(r["ticker"], r["rd_pct"]): r for r in P.company_figures(spark.createDataFrame(rows, "ticker string, sector string, html string")).collect()}
    a = got["A", 3.0]
    assert (a["market_cap"], a["pe_ratio"], a["roce"], a["roe"], a["debt_to_equity"], a["dividend_yield"]) == (184000.0, 24.5, 18.2, 12.0, None, None)
    assert (a["q_sales"], a["qoq_sales_growth"], a["sales_trend"], a["capex"]) == (1250.5, 725.25, [100.0, -200.0, 1250.5], 250.1)
    # an unclosed cell ends where the next begins: 12 and 15.5, not 1215.5
    assert (a["q_opm"], a["opm_expansion"], a["opm_trend"]) == (15.5, 3.5, [12.0, 15.5])
    assert (a["ttm_eps"], a["eps_trend"], a["q_net_profit"]) == (10.25, [1.0, 2.0, 3.25, 4.0], None)
    assert (a["promoter_pct"], a["promoter_change"], a["fii_pct"], a["pledged_pct"], a["pledged_change"], a["pledged_trend"]) == (50.1, -1.1, None, 3.5, None, None)
    assert (got["B", 10.5]["capex"], got["B", 10.5]["q_sales"]) == (0.0, None) and got["C", 1.5]["sales_trend"] is None
    assert (got["C", None]["capex"], got["C", None]["rd_expenditure"]) == (7.0, 9.0)


def test_ties_round_to_even(spark):
    page = '<section id="quarters"><table><tr><td>EPS</td>' + "".join(f"<td>{x}</td>" for x in (8, 8, 8, 8.125)) + "</tr></table></section>"
    assert P.company_figures(spark.createDataFrame([("a", None, page)], "ticker string, sector string, html string")).first()["ttm_eps"] == 32.12


def test_growth_from_nothing(spark):
    page = lambda *v: '<section id="quarters"><table><tr><td>Sales</td>' + "".join(f"<td>{x}</td>" for x in v) + "</tr></table></section>"
    frame = spark.createDataFrame([("a", None, page(0, 5)), ("b", None, page(5)), ("c", None, page(-50, -100))], "ticker string, sector string, html string")
    assert {r["ticker"]: r["qoq_sales_growth"] for r in P.company_figures(frame).collect()} == {"a": 0.0, "b": None, "c": -100.0}


APPROVED = """<html><head><style>p {}</style><script>var x = "Hidden Works Ltd";</script></head><body><p>Solar units</p><table><tr><th>Company Name</th></tr>
<tr><td>1. Acme <b>Power</b></td><td>x</td><tr><td>2) Beta &amp; Sons</td></tr><tr><td>abc</td></tr><tr><td>two
lines</td></tr></table><ul><li>acmepower</li><li>Zeta Motors</li></ul><ol><li>No list</li></ol><!-- Gone Works Ltd --><p>Also approved are Gamma Wind Industries and delta Ltd.</p></body></html>"""


def test_approvals(spark):
    rows = [(1, "List", APPROVED, "d1"), (2, "White Goods PLI 2.0", APPROVED, "d2"), (3, None, None, None), (4, "t", "<p>" + "x" * 600 + " telecom 2.0 Late Solutions</p>", "d3"), (5, "t", "<table><tr><td>" + "y" * 90 + "</td></tr></table>", "d4")]
    got = P.approvals(spark.createDataFrame(rows, "page_id int, title string, html string, day string")).orderBy("page_id", "place").collect()
    names = lambda k: [r["name"] for r in got if r["page_id"] == k]
    assert names(1) == names(2) == ["AcmePower", "Beta & Sons", "Zeta Motors", "Gamma Wind Industries"]
    assert {(r["page_id"], r["sector"], r["scheme"]) for r in got} == {(1, "Solar", "PLI Scheme"), (2, "White Goods", "PLI 2.0"), (4, "Manufacturing", "PLI Scheme")}
    assert names(4) == ["Late Solutions"] and names(5) == []


def test_firms(spark):
    texts = ["Acme Ltd Beta Corp Zed won", "A Beta Ltd_x", "Acme B Ltd", "In Acme Industries Limited, iPhone Ltd. Corporate", "Acme\u00a0Ltd", "Word " * 30_000 + "Ltd", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(P.firms(F.col("t"))).collect()]
    assert got[:5] == [["Acme Ltd Beta Corp"], [], [], ["In Acme Industries Limited"], ["Acme\u00a0Ltd"]] and len(got[5][0]) == 150_003 and got[6] is None
    long = "<b></b>" * 50_000 + "<ul>" + "<li>Item" * 3_000
    assert P.approvals(spark.createDataFrame([(1, "t", long, "d")], "page_id int, title string, html string, day string")).count() == 1


def test_radar(spark):
    rows = [(i, 0, "Acme", "Solar", "PLI Scheme" if i % 2 else "PLI 2.0", f"d{i // 2}") for i in range(5)] + [(9, 1, "Zeta", "Drone", "PLI 2.0", None)]
    got = P.radar(spark.createDataFrame(rows, "page_id int, place int, name string, sector string, scheme string, day string")).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("Acme", 5, "d0", ["PLI 2.0 Solar", "PLI Scheme Solar", "PLI 2.0 Solar"]), ("Zeta", 1, None, ["PLI 2.0 Drone"])]


def test_empty(spark):
    none = spark.createDataFrame([], "page_id int, title string, html string, day string")
    assert P.radar(P.approvals(none)).count() == 0 == P.company_figures(none.select(F.col("page_id").alias("ticker"), F.col("title").alias("sector"), "html")).count()
