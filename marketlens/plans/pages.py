"""Registered queries over pages: figures of companies, approvals and who is named in them, each beside its SQL.

The test data has no such pages, so they are spelled from suppliers, their quarters and orders, with the markup that
pages have: labels in buttons, cells that are not closed, commas, signs, missing rows. The SQL reads no markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import pages
from marketlens.plans.catalogue import METRICS, QUARTERS, query
from marketlens.sources.tables import metrics, sales_series, table


def _row(label: str, *cells) -> object:
    return F.concat(F.lit(f"<tr><td><button>{label}&nbsp;<span>+</span></button></td>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _company_pages(spark: SparkSession, d: str) -> DataFrame:
    sold = sales_series(spark, d).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("period", "sales"))).alias("quarters"))
    m = metrics(spark, d).join(sold, "ticker", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    item = lambda label, value: F.concat(F.lit(f'<li><span class="name">\n {label} </span><span class="nowrap value">Rs <span class="number">'), value, F.lit("</span></span></li>"))
    sales = F.concat(F.lit("<tr><td><button>Sales&nbsp;<span>+</span></button></td>"), F.concat_ws("", F.transform("quarters", lambda q: F.concat(F.lit("<td>"), F.format_number(q["sales"], 2)))), F.lit("</tr>"))
    page = F.concat(
        F.lit('<html><body><div class="card company-ratios"><ul>'), item("Market Cap", F.format_number("value", 2)), item("Stock P/E", text("pe")), item("ROCE", text("roce")), item("ROE", text("roe")),
        item("Debt to equity", F.when(F.col("ticker") % 6 == 0, "n/a").otherwise(text("debt_equity"))), F.lit("</ul></div>"),
        F.lit('<section id="quarters"><h2>Quarterly</h2><table><tr><th></th><th>Mar</th></tr>'), F.coalesce(F.when(F.col("ticker") % 10 != 4, sales), F.lit("")),
        _row("OPM %", *[F.concat(text(c), F.lit("%")) for c in ("margin_1", "margin_2", "margin_3")]), _row("EPS in Rs", *[text(c) for c in ("eps", "q_eps", "eps", "q_opm", "current_ratio")]), F.lit("</table></section>"),
        F.lit('<section id="cash-flow"><table>'), F.when(F.col("ticker") % 3 == 1, _row("Fixed assets purchased", F.lit("-3"), F.concat(F.lit("-"), text("debt")))).otherwise(""), F.lit("</table></section>"),
        F.lit('<section id="shareholding"><table>'), _row("Promoters", F.lit("50.5%"), F.concat(text("share"), F.lit("%"))), F.when(F.col("pledged").isNotNull(), _row("Pledged percentage", F.lit("1.25"), text("pledged"))).otherwise(""), F.lit("</table></section></body></html>"),
    )
    return m.select("ticker", F.when(F.col("ticker") % 8 == 2, "clean_energy").otherwise(F.col("sector")).alias("sector"), page.alias("html"))


@query(f"""WITH m AS ({METRICS}), q AS ({QUARTERS}), l AS (SELECT ticker, list(sales ORDER BY period) AS l FROM q WHERE ticker % 10 <> 4 GROUP BY 1)
SELECT m.ticker, value AS market_cap, pe AS pe_ratio, roce, roe, CASE WHEN m.ticker % 6 <> 0 THEN debt_equity END AS debt_to_equity, l[-1] AS q_sales, CASE WHEN len(l) > 1 THEN CASE WHEN l[-2] = 0 THEN 0 ELSE round_even((l[-1] - l[-2]) / abs(l[-2]) * 100, 2) END END AS qoq_sales_growth,
  l[greatest(1, len(l) - 7)] AS trend_first, CASE WHEN l IS NOT NULL THEN least(8, len(l)) END AS trend_n, margin_3 AS q_opm, margin_3 - margin_2 AS opm_expansion, round_even(CASE WHEN current_ratio IS NULL THEN eps + q_eps + eps + q_opm ELSE q_eps + eps + q_opm + current_ratio END, 2) AS ttm_eps,
  CASE WHEN m.ticker % 3 = 1 THEN debt ELSE round_even(coalesce(l[-1], 0) * 4 * 0.05, 1) END AS capex, CASE WHEN m.ticker % 8 = 2 THEN 3.0 ELSE 1.5 END AS rd_pct, share AS promoter_pct, round_even(share - 50.5, 2) AS promoter_change, pledged AS pledged_pct, round_even(pledged - 1.25, 2) AS pledged_change
FROM m LEFT JOIN l ON m.ticker = l.ticker""")
def company_page_figures(spark: SparkSession, d: str) -> DataFrame:
    """Ratios, newest figures, changes and trends out of every company's page."""
    read = pages.company_figures(_company_pages(spark, d))
    return read.select(
        "ticker", "market_cap", "pe_ratio", "roce", "roe", "debt_to_equity", "q_sales", "qoq_sales_growth", F.get("sales_trend", F.lit(0)).alias("trend_first"), F.array_size("sales_trend").cast("long").alias("trend_n"), "q_opm", "opm_expansion", "ttm_eps",
        "capex", "rd_pct", "promoter_pct", "promoter_change", "pledged_pct", "pledged_change",
    )


_TITLES = "CASE o_orderkey % 4 WHEN 0 THEN 'Approvals under PLI 2.0 for Textile units' WHEN 1 THEN 'DRONE makers approved' WHEN 2 THEN 'approved list' END"


def _approval_pages(spark: SparkSession, d: str) -> DataFrame:
    html = """concat('<html><head><script>var a = "Hidden Works Ltd";</script></head><body><table><tr><th>Company Name</th><tr><td>1. Omega', o_custkey % 8, ' <b>Works</b></td><td>', if(o_custkey % 3 = 0, 'Textile', 'Other'),
      '</table><ul><li>', if(o_custkey % 7 = 0, concat('OMEGA', o_custkey % 8, 'works'), 'abc'), '<li>Beta', o_custkey % 30, ' &amp; Sons</li></ul><p>also approved are Gamma', o_custkey % 5, ' Wind Industries, for ', if(o_custkey % 5 = 1, 'solar', 'no'), ' use.</p></body></html>')"""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.expr(_TITLES).alias("title"), F.expr(html).alias("html"), F.col("o_orderdate").cast("date").alias("day"))


_APPROVED = """ap AS (SELECT o_orderkey AS page_id, CAST(o_orderdate AS DATE) AS day, o_custkey AS c, CASE WHEN o_orderkey % 4 = 0 OR o_custkey % 3 = 0 THEN 'Textile' WHEN o_custkey % 5 = 1 THEN 'Solar' WHEN o_orderkey % 4 = 1 THEN 'Drone' ELSE 'Manufacturing' END AS sector,
  CASE WHEN o_orderkey % 4 = 0 THEN 'PLI 2.0' ELSE 'PLI Scheme' END AS scheme FROM orders),
nm AS (SELECT page_id, day, sector, scheme, 0 AS place, 'Omega' || CAST(c % 8 AS VARCHAR) || 'Works' AS name FROM ap UNION ALL SELECT page_id, day, sector, scheme, 1, 'Beta' || CAST(c % 30 AS VARCHAR) || ' & Sons' FROM ap UNION ALL SELECT page_id, day, sector, scheme, 2, 'Gamma' || CAST(c % 5 AS VARCHAR) || ' Wind Industries' FROM ap)"""


@query(f"WITH {_APPROVED} SELECT page_id, name, sector, scheme, CAST(day AS VARCHAR) AS day FROM nm")
def approval_pages(spark: SparkSession, d: str) -> DataFrame:
    """The companies that every approval page names, with its sector and scheme."""
    return pages.approvals(_approval_pages(spark, d)).select("page_id", "name", "sector", "scheme", F.col("day").cast("string").alias("day"))


@query(f"""WITH {_APPROVED}, ra AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY day, page_id, place) AS r FROM nm)
SELECT name, count(*) AS n_approvals, CAST(min(day) AS VARCHAR) AS first_day, string_agg(scheme || ' ' || sector, '; ' ORDER BY r) FILTER (WHERE r <= 3) AS schemes FROM ra GROUP BY name""")
def approval_radar(spark: SparkSession, d: str) -> DataFrame:
    """Every company that was approved, with its first three approvals."""
    found = pages.radar(pages.approvals(_approval_pages(spark, d)))
    return found.select("name", "n_approvals", F.col("first_day").cast("string").alias("first_day"), F.concat_ws("; ", "schemes").alias("schemes"))
