"""Merges, deduplication and top-k with an explicit order, so that equal inputs give equal results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import apart

ROWS_A_TASK = 250_000
BLOCK = 2048


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark cuts each task's rows to one a key before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_of(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def history_merge(new: DataFrame, old: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both runs; on equal keys the newer run wins, then the earlier place."""
    both = new.withColumn("run", F.lit(0)).unionByName(old.withColumn("run", F.lit(1)))
    return first_of(both, keys, [F.col("run"), *map(F.col, order)])


def last_wins(rows: DataFrame, keys: list[str], place: str, values: list[str]) -> DataFrame:
    """The last row's values at the first row's place: an aggregate, so partial results are combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(place).alias(place), *[F.max_by(v, place).alias(v) for v in values])


def fill_from(rows: DataFrame, master: DataFrame, key: str, column: str) -> DataFrame:
    """Fills nulls of a column from a master table with one row a key."""
    return rows.join(master.select(key, F.col(column).alias("_fill")), key, "left").withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def pairs_within(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct unordered pairs of items that a group names, with the number of groups. Groups are short lists.

    Groups are dealt once, to as many tasks as there are ``ROWS_A_TASK``, so what a task sorts does not grow with the input.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_A_TASK + 1)
    one = rows.select(group, F.col(item).alias("a")).repartition(n, group).distinct()
    return one.join(one.withColumnRenamed("a", "b"), group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_groups"))


def crossed(left: DataFrame, right: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """left.join(right, key) where few keys hold most rows on both sides, so that the result grows with their product.

    A key's rows are dealt to blocks of some ``block`` rows on either side, and every two blocks meet in one piece. Pieces
    are spread over the tasks, of which there are as many as pieces. Keys are few, and their sizes are broadcast.
    """
    left, right = apart(left), apart(right)
    of = lambda rows, name: rows.groupBy(key).agg(F.expr(f"1 + count(*) div {block}").alias(name))
    sizes = apart(of(left, "_of_i").join(of(right, "_of_j"), key))
    pieces = sizes.agg(F.sum(F.col("_of_i") * F.col("_of_j"))).first()[0] or 1
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces)
    at = lambda rows, count: F.pmod(F.xxhash64(*rows.columns), F.col(count))
    all_of = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = left.join(F.broadcast(sizes), key).select(*left.columns, at(left, "_of_i").alias("_i"), all_of("_of_j").alias("_j"))
    right = right.join(F.broadcast(sizes), key).select(*right.columns, all_of("_of_i").alias("_i"), at(right, "_of_j").alias("_j"))
    # by number, as Spark would put pieces together by their bytes, which are few, and not by what comes of them
    met = [key, "_i", "_j"]
    return left.repartition(n, *met).join(right.repartition(n, *met).hint("merge"), met).drop("_i", "_j")


def capped_total(rows: DataFrame, keys: list[str], order: list[str], points: str, cap: float) -> DataFrame:
    """Points in order until the cap is reached: counted events and their capped total."""
    before = F.coalesce(F.sum(points).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).where(F.col("_before") < cap).groupBy(*keys).agg(F.count("*").alias("n_counted"), F.least(F.sum(points), F.lit(cap)).alias("total"))
