"""Columns of any name and type beside the operators' own: dots, spaces, maps, dates, clashing names."""

import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.llm import bpe, mainhtml, quality

KIND = "doc_id long, text string, lang string, source string, n_chars int, `my col` string, `a.b` map<string,int>, day date, row struct<x:int,`y z`:array<string>>, key string, cut array<int>, word string, size int"
DAY = datetime.date(2026, 1, 2)


def _docs(spark):
    words = [" ".join(f"w{(7 * i + 3 * j * j) % 211}" for j in range(90)) for i in range(6)]
    texts = [words[0], words[0], words[1] + "\n" + words[2], words[2], None, words[3], words[3]]
    other = lambda i: (f"m{i}", {"k": i}, DAY, (i, ["a"]), "key", [i], "word", 5)
    return spark.createDataFrame([(i // 2 if i > 4 else i, t, "en", "s", len(t or ""), *other(i)) for i, t in enumerate(texts)], KIND)


def test_any_columns(spark):
    docs = _docs(spark)
    judged = quality.quality_rules(docs)
    assert judged.schema["row"].dataType == docs.select(F.struct("*").alias("row")).schema["row"].dataType and judged.count() == docs.count()
    assert sorted(r["my col"] for r in judged.select("row.*").collect()) == [f"m{i}" for i in range(7)]
    few = ["doc_id", "my col", "a.b"]
    got = bpe.digests(bpe.encoded(docs, "word_bpe_49k.json", few))
    assert got.columns[:3] == few and sorted(r["a.b"]["k"] for r in got.collect()) == list(range(7))
    pages = spark.createDataFrame([(1, "<article><p>one two</p></article>", {"k": 1}, "x")], "page_id long, html string, `a.b` map<string,int>, `my col` string")
    r = mainhtml.extracted(pages, ["page_id", "a.b", "my col"]).first()
    assert (r["text"], r["row"]["a.b"], r["row"]["my col"]) == ("one two", {"k": 1}, "x")


def test_pipeline_any_columns(spark):
    import corpus_pipeline

    docs = _docs(spark)
    for rows in (docs, docs.limit(0)):
        frame = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = corpus_pipeline.written(stage(spark, frame, ""))
            assert frame.columns == docs.columns and frame.schema["a.b"].dataType == docs.schema["a.b"].dataType, name
        encoded = corpus_pipeline.encoding(spark, frame, "")
        assert encoded.count() == frame.count()
    # of copies under one doc_id one stays, and the same one in each run
    same = docs.where("doc_id >= 2 and text is not null").unionByName(docs)
    kept = [sorted(r["my col"] for r in corpus_pipeline.near_dedup(spark, same.repartition(n), "").collect()) for n in (1, 3)]
    assert kept[0] == kept[1] == ["m0", "m2", "m3", "m4", "m5"]


def test_bpe_tables_kept(monkeypatch):
    """What is kept between tasks gives the same ids, also where only a part is kept."""
    import public_tokenizers

    texts = pa.array([f"word{i} Other{i * i}. naïve-{i % 7} #{i}" for i in range(400)] + [None, "", "word1 word2"])
    coder = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [x.to_pylist() for x in coder.encode(texts)]
    for name, kept in (("KEPT_PIECES", 100), ("KEPT_WORDS", 50), ("KEPT_PAIRS", 20)):
        monkeypatch.setattr(bpe, name, kept)
    for k in (0, 200):
        coder.rest()
        assert len(coder.pieces.keys) <= 100 and len(coder.held) <= 50 and len(coder.pairs) <= 20
        assert [x.to_pylist() for x in coder.encode(texts[k:])] == [x[k:] for x in want]
