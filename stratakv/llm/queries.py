"""One query for each training-data operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import ann, licenses, minhash, mixing, pieces, quality, substring, suffix, toxicity, warc
from stratakv.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text")).select(*cols)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), pieces.vocabulary(), check=True)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sizes_of(read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(read(spark, sf_dir, "documents"), n=2, percent=80)
    return found.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_nearest_neighbours, op3_license_scan, op4_substring_dedup, op5_sentencepiece, op6_mixing, op7_toxicity, op8_suffix_dedup, op9_warc, op10_minhash)}
ORACLES = {"op1_quality_rules": quality.SQL, "op4_substring_dedup": substring.SQL, "op6_mixing": mixing.SQL, "op9_warc": warc.SQL, "op10_minhash": minhash.SQL}
