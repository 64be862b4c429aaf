"""Streams that remember, run over files that arrive one after another."""

import datetime

from marketlens.streaming import state
from marketlens.streaming.incremental import drained

DAY = datetime.date


def test_status_stream(spark, tmp_path):
    kind = "ticker string, category string, run date, severity string"
    runs = [[("A", "x", DAY(2026, 1, 1), "Medium"), ("B", "x", DAY(2026, 1, 1), "Low")], [("A", "x", DAY(2026, 1, 2), "High"), ("B", "x", DAY(2026, 1, 2), "Low"), ("A", "y", DAY(2026, 1, 2), "Low")], [("A", "x", DAY(2026, 1, 3), "Low")]]
    for i, rows in enumerate(runs):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    got = {(r["ticker"], r["category"], r["run"].day): r["status"] for r in drained(state.warning_status(stream), str(tmp_path / "check")).collect()}
    assert got == {("A", "x", 1): "new", ("B", "x", 1): "new", ("A", "x", 2): "escalated", ("B", "x", 2): "ongoing", ("A", "y", 2): "new", ("A", "x", 3): "ongoing"}


def test_ripe_decisions(spark, tmp_path):
    at = lambda m, d: datetime.datetime(2026, m, d)
    source = str(tmp_path / "in")
    for rows in ([("1", at(1, 1)), ("2", at(2, 20))], [("3", at(3, 1))], [("4", at(3, 2))]):
        spark.createDataFrame(rows, "id string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    got = drained(state.ripe_decisions(stream), str(tmp_path / "check")).collect()
    assert [(r["id"], r["decided"].day, r["due"].day) for r in got] == [("1", 1, 15)]


def test_insert_only(spark, tmp_path):
    folder = str(tmp_path / "master")
    made = lambda rows: spark.createDataFrame(rows, "symbol string, isin string")
    assert state.insert_only(made([("A", "1"), ("B", "2"), ("A", "1"), (None, "9")]), folder, "symbol") == 2
    assert state.insert_only(made([("A", "5"), ("C", "3")]), folder, "symbol") == 1
    assert sorted(map(tuple, spark.read.parquet(folder).collect())) == [("A", "1"), ("B", "2"), ("C", "3")]


def test_scoring_grows_with_the_rows():
    """Decisions and prices of one ticker in one step: no decision is compared with every price."""
    import time
    from types import SimpleNamespace

    import pandas as pd

    n, kept = 20_000, []
    start = pd.Timestamp("2026-01-01")
    asked = pd.DataFrame({"ts": [start + pd.Timedelta(minutes=i) for i in range(n)], "id": [str(i) for i in range(n)], "price": 1.0, "target": 2.0})
    told = pd.DataFrame({"ts": [start + pd.Timedelta(days=20, minutes=2 * i) for i in range(n)], "id": None, "price": [float(i) for i in range(n)], "target": float("nan")})
    held = SimpleNamespace(exists=False, hasTimedOut=False, getCurrentWatermarkMs=lambda: int(start.timestamp() * 1000) + 90 * 86_400_000, update=kept.append, setTimeoutTimestamp=lambda t: None)
    began = time.process_time()
    (rows,) = state._scoring(45)(("A",), iter([asked, told]), held)
    assert time.process_time() - began < 15
    # the price of 25 days after the first one, then every second minute
    assert rows["price"].tolist() == [float(min(n - 1, (25 * 1440 + i) // 2)) for i in range(n)]
