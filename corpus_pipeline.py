"""The corpus pipeline: stages that clean, deduplicate, mix and encode documents.

Stages work on whole texts of any length and pass other columns through, whatever their names. An empty table gives an
empty result. Ties are decided by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, lines, minhash, mixing, quality
from marketlens.llm.store import dropped, written
from marketlens.session import with_checkpoints

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: those without text, of under 50 words, and those outside the limits.

    Repeated rows are judged each by itself; nulls in other columns are groups or values like any other.
    """
    with_checkpoints(spark)
    return quality.quality_rules(docs).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; documents stay, but for those whose every line was a repeat.

    A null text stays null. Rows with equal doc_id and text are cut alike.
    """
    with_checkpoints(spark)
    found = lines.without_repeated_lines(docs)
    return found.where("n_removed = 0 or n_removed < n_lines").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays; of rows with equal doc_id and text, one.
    Rows with a null doc_id stay."""
    with_checkpoints(spark)
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    # a document is a doc_id with a text, as a doc_id may repeat with other texts
    named = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id").where("key is not null").distinct()
    named = written(named.join(docs.select("doc_id", key.alias("key")).distinct(), "key"))
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = written(named.join(first, "component_id").where("key <> first.key").select("key"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key")).join(gone, "key", "left_anti")
    again = written(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    # of rows that are alike but for other columns, by their text, as not every type has an order
    one = rows.join(again, "key").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(again, "key", "left_anti").select("row.*").unionByName(one.select("row.*"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents, cut at the end of a source's target, repeated where the target asks for it.

    Documents without words have no part in it; a null source is a source.
    """
    with_checkpoints(spark)
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256 of each row of the mix; a null text has no ids."""
    rows = bpe.encoded(docs, VOCABULARY, ["doc_id", "lang", "source"])
    return bpe.digests(rows.withColumn("row", F.col("row").withField("ids", F.col("ids"))))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("source mix", source_mix), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written to the shared folder and read again."""
    docs = with_checkpoints(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = written(made)
            if i:  # never the input itself
                dropped(docs)
        docs = made
    return docs
