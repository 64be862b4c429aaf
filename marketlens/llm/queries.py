"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import audit, bpe, hmm, lines, mainhtml, minhash, mixing, partitions, phrases, preference, quality, simhash, variants
from marketlens.session import with_checkpoints


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return with_checkpoints(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_read(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.RATES)


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(with_checkpoints(spark), _read(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encoded(_read(spark, sf_dir, "documents"), "word_bpe_49k.json", ["doc_id"]))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return partitions.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix_sources(_read(spark, sf_dir, "documents")))


def op7_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.without_repeats(_read(spark, sf_dir, "documents"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeated_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2("row.text", 256).alias("kept_sha256"))


def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mainhtml.extracted(_read(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("row.*", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference.preference_examples(*preference.pairs_from_conversations(_read(spark, sf_dir, "conversations")))
    return found.withColumnRenamed("pair", "pair_id")


def op11_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op10_preference": preference.PREFERENCE_SQL, "op12_filter_audit": audit.AUDIT_SQL}
