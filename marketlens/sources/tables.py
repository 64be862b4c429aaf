"""Tables as the engine reads them, and the market views made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(column: str | Column) -> Column:
    """A sum of money that does not depend on the order of addition."""
    return F.sum(F.col(column).cast("decimal(18,2)") if isinstance(column, str) else column.cast("decimal(18,2)")).cast("double")


def holdings(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, name, sector, region, value: suppliers stand for listed companies, nations for sectors."""
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("value")
    )


def sales_series(spark: SparkSession, folder: str, unit: str = "quarter") -> DataFrame:
    """ticker, period, sales: summed before anything is joined, so only totals are shuffled."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.date_trunc(unit, "l_shipdate").alias("period")).agg(money("l_extendedprice").alias("sales"))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Holdings with the figures that the rules read, as whole-number functions of the ticker where no table has them."""
    whole = lambda a, m, shift, div: F.expr(f"(pmod(ticker * {a}, {m}) - {shift}) / {div}.0").cast("double")
    made = holdings(spark, folder).select(
        "*", whole(7, 11, 5, 2).alias("promoter_change"), whole(5, 13, 8, 2).alias("fii_change"), whole(3, 9, 4, 2).alias("dii_change"), whole(11, 31, 12, 1).alias("qoq"), whole(13, 17, 0, 8).alias("current_ratio"),
        whole(17, 23, 0, 16).alias("debt_equity"), whole(19, 29, 16, 1).alias("opm_change"), whole(23, 19, 11, 1).alias("day_change"), whole(29, 37, 0, 16).alias("volume_surge"), whole(31, 21, 0, 16).alias("price_to_ma"),
        whole(37, 41, 0, 1).alias("pe"), whole(41, 43, 0, 2).alias("pledged"), whole(43, 7, 3, 2).alias("pledged_change"), whole(47, 53, 0, 1).alias("above_low"), whole(53, 61, 10, 4).alias("eps"),
        whole(59, 67, 20, 1).alias("growth"), whole(61, 71, 0, 2).alias("roce"), whole(67, 73, 0, 2).alias("roe"), whole(71, 79, 0, 1).alias("analysts"), whole(73, 83, 0, 1).alias("price"), whole(79, 89, 0, 1).alias("target"),
        whole(131, 307, 0, 1).alias("pe_wide"), whole(83, 97, 0, 1).alias("debt"), whole(89, 101, 0, 1).alias("net_assets"), whole(97, 5, 0, 2).alias("dividend"), whole(101, 23, 3, 1).alias("q_eps"), whole(103, 29, 4, 1).alias("q_opm"),
        whole(107, 9, 0, 2).alias("rec"), whole(127, 211, 50, 1).alias("sales_var"), whole(109, 221, 60, 1).alias("profit_var"), whole(113, 41, 0, 8).alias("share"), whole(137, 53, 10, 1).alias("revenue_last"), whole(139, 53, 10, 1).alias("revenue_before"),
        whole(149, 31, 0, 1).alias("margin_1"), whole(151, 31, 0, 1).alias("margin_2"), whole(157, 31, 0, 1).alias("margin_3"),
    )
    # some companies lack some figures
    lacking = {"pledged": (13, 5), "above_low": (11, 3), "current_ratio": (17, 2), "profit_var": (7, 3), "rec": (19, 4), "qoq": (23, 7)}
    return made.withColumns({c: F.when(F.col("ticker") % a != b, F.col(c)) for c, (a, b) in lacking.items()})
