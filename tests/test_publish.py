"""Tables that are replaced while somebody reads them, by writers that may die; records with fields that nobody knows."""

import json

import pytest
from pyspark.sql import functions as F

from marketlens.sources import files, publish


def test_publish(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    got = lambda frame: sorted(r["k"] for r in frame.collect())
    assert publish.current_version(spark, folder) is None and publish.read(spark, folder, schema="k int").count() == 0
    with pytest.raises(FileNotFoundError):
        publish.read(spark, folder)
    publish.publish(rows(1, 2), folder)
    before = publish.read(spark, folder)
    # a table made from itself, while an earlier reader goes on
    publish.publish(publish.read(spark, folder).unionByName(rows(3)), folder)
    assert got(before) == [1, 2] and got(publish.read(spark, folder)) == [1, 2, 3]
    # the same version again has no effect
    publish.publish(rows(7), folder, version="b1")
    publish.publish(rows(8), folder, version="b1")
    assert got(publish.read(spark, folder)) == [7]
    for i in range(2 * publish.KEPT):
        publish.publish(rows(i), folder)
    assert got(publish.read(spark, folder)) == [2 * publish.KEPT - 1]
    assert len(list((tmp_path / "t" / "versions").iterdir())) <= publish.KEPT + 1 and [p.name for p in (tmp_path / "t").iterdir() if "CURRENT." in p.name and not p.name.endswith(".crc")] == []


def test_publish_dies_halfway(spark, tmp_path):
    """A writer that fails in its second table, after files were written: readers keep the old run, and the next one succeeds."""
    folder = str(tmp_path / "t")
    one = spark.range(10).select(F.col("id").alias("k"))
    publish.publish({"a": one, "b": one}, folder, version="v1")
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("dies"))).otherwise(F.col("id")).cast("long").alias("k"))
    with pytest.raises(Exception, match="dies"):
        publish.publish({"a": spark.range(5).select(F.col("id").alias("k")), "b": bad}, folder, version="v2")
    assert publish.current_version(spark, folder) == "v1" and publish.read(spark, folder, "a").count() == publish.read(spark, folder, "b").count() == 10
    publish.publish({"a": spark.range(5).select(F.col("id").alias("k")), "b": one}, folder, version="v2")
    assert publish.read(spark, folder, "a").count() == 5


def test_briefing_tables(spark, tmp_path):
    folder = str(tmp_path / "t")
    corpus = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    coverage = lambda *x: spark.createDataFrame([(t, i) for i, t in enumerate(x)], "ticker string, id int")
    files.write_briefing(corpus, corpus.where("k = 1"), coverage("M&M", "abc", "x/y", "&"), folder)
    files.write_briefing(corpus, corpus.where("k = 1"), coverage("abc", "abc"), folder)
    # a ticker that is gone has no folder any more
    assert sorted(r["ticker"] for r in publish.read(spark, folder, "coverage").collect()) == ["ABC", "ABC"]
    assert (publish.read(spark, folder, "corpus").count(), publish.read(spark, folder, "display").count()) == (2, 1)
    files.write_run(spark.range(1000).repartition(7), str(tmp_path / "s"), order=["id"])
    parts = [[r["id"] for r in spark.read.parquet(str(p)).collect()] for p in sorted((tmp_path / "s" / "versions").glob("*/rows/part-*"))]
    assert sum(parts, []) == list(range(1000))
    old = str(tmp_path / "old")
    corpus.write.parquet(old)
    assert files.previous_run(spark, old, "k int, v string").count() == 2


# fixed values: records as files hold them, and as they are written again
RECORDS = [
    ({"ticker": "A", "name": "Aco", "price": "1,840.00", "growth_pct": 23.0, "screener": {"roe": [1, 2.5]}, "my field": None}, {"ticker": "A", "name": "Aco", "price": "1840.00", "growth_pct": "+23.0%", "screener": {"roe": [1, 2.5]}, "my field": None}),
    ({"ticker": "B", "price": "N/A", "revenue_growth": "-9.2%", "analyst_count": "7", "rating": None, "fundamental_value": 12.25}, {"ticker": "B", "price": None, "revenue_growth": "-9.2%", "analyst_count": 7, "rating": "N/A", "fundamental_value": 12.25}),
    ({"name": "No ticker", "price": "12"}, None), ({"ticker": None}, None), ({"ticker": "C", "name": 5}, None), ("no record", None), ({"ticker": "D", "earnings_growth": "0"}, {"ticker": "D", "earnings_growth": "0.0%"}),
]


def test_records(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"s": [x for x, _ in RECORDS], "t": "no list", "u": []}))
    rows = files.records(spark, str(path))
    got = {(r["sector"], r["ord"]): r for r in rows.withColumns({"rest": F.to_json("rest"), "raw": F.to_json("raw")}).collect()}
    for i, (record, written) in enumerate(RECORDS):
        r = got["s", i]
        assert r["valid"] == (written is not None), record
        assert json.loads(r["raw"]) == record
        if written is None:
            assert r["ticker"] is r["price"] is r["rest"] is None
    assert json.loads(got["s", 0]["rest"]) == {"screener": {"roe": [1, 2.5]}, "my field": None} and got["s", 1]["rest"] is None
    assert (got["s", 0]["price"], got["s", 0]["growth_pct"], got["s", 1]["analyst_count"], got["s", 1]["rating"]) == (1840.0, 23.0, 7, "N/A")
    assert json.loads(got["t", 0]["raw"]) == "no list" and not got["t", 0]["valid"]
    back = {(r["sector"], r["ord"]): json.loads(r["record"]) for r in files.wire(rows).collect()}
    assert [back["s", i] for i in range(len(RECORDS))] == [w if w is not None else x for x, w in RECORDS]
    assert files.records(spark, str(tmp_path / "none.json")).count() == 0


def test_coverage_makes_few_files(spark, tmp_path):
    """As many files as tasks, not as companies, and a ticker's rows beside each other."""
    folder, n = str(tmp_path / "b"), 400
    rows = spark.range(2 * n).selectExpr("concat('007', id % 400) as ticker", "id as k")
    files.write_briefing(rows, rows, rows, folder)
    got = publish.read(spark, folder, "coverage")
    assert len(got.inputFiles()) <= 16 and got.count() == 2 * n and got.schema["ticker"].dataType.simpleString() == "string"
    placed = got.selectExpr("ticker", "_metadata.file_name as f").distinct().groupBy("ticker").count()
    assert placed.where("count > 1").isEmpty() and placed.count() == n
