"""What joins send to every worker."""

from pyspark.sql import functions as F

from marketlens.operators import attribution, sets
from marketlens.plans import research


def _broadcast(frame):
    """The lines of the plan that stand below a broadcast."""
    found, above = [], None
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if above is not None and depth <= above:
            above = None
        if above is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            above = depth
    return found


def test_runs_of_headlines_are_never_broadcast(spark, data):
    # small files, at Spark's own threshold; headlines' runs are many times as large as the optimiser takes them for
    lines = _broadcast(research.new_entrants(spark, data))
    assert lines and not [x for x in lines if "Generate" in x and "flatten" in x]
    assert not [x for x in lines if "o_orderkey" in x]


def test_headlines_and_their_orders_are_never_broadcast(spark, data):
    for frame in (research._headlines(spark, data), research.coverage_counts(spark, data), research.new_entrants(spark, data)):
        assert not [x for x in _broadcast(frame) if "o_orderkey" in x or "flatten" in x]


def test_pairs_are_dealt_by_size(spark, monkeypatch):
    from marketlens.operators import sets

    monkeypatch.setattr(sets, "ROWS_A_TASK", 10)
    rows = spark.range(900).selectExpr("id div 3 as o", "id % 7 as s")
    found = sets.pairs_within(rows, "o", "s")
    want = {}
    for o in range(300):
        s = sorted({i % 7 for i in range(3 * o, 3 * o + 3)})
        for i, a in enumerate(s):
            for b in s[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["n_groups"] for r in found.collect()} == want
    assert "hashpartitioning(o" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 91)" in plan


def test_entrant_warnings_are_dealt(spark):
    """One sector that holds most rows on both sides is spread over many tasks, and every pair is there once."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entrants = spark.range(9000).select(F.when(F.col("id") < 3, "small").otherwise("large").alias("sector"), F.format_string("c%d", "id").alias("challenger"), "id")
        companies = spark.range(5000).select(F.format_string("T%d", "id").alias("ticker"), F.when(F.col("id") % 1000 == 0, "small").when(F.col("id") == 7, "other").otherwise("large").alias("sector"))
        got = attribution.entrant_warnings(entrants, companies)
        n = 3 * 5 + 8997 * 4994
        by_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(by_task) == n and len(by_task) >= 5 and max(by_task) < n / 2
        assert got.select("ticker", "challenger").distinct().count() == n
        assert got.columns == ["ticker", "sector", "challenger", "severity", "direction", "category"]
        assert attribution.entrant_warnings(entrants.limit(0), companies).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_crossed_as_joined(spark):
    """Null keys meet nothing, keys of one side alone neither, and equal rows count as often as in a join."""
    left = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "k string, x int")
    right = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 9), (None, 4), ("d", 5)], "k string, y int")
    for block in (1, 2, 100):
        assert sorted(map(tuple, sets.crossed(left, right, "k", block).select("k", "x", "y").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
