"""The corpus pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of documents. Edge cases are those of the operators, see their modules; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import minhash, mixing, pieces, quality, substring
from stratakv.llm.common import read, written


def apart(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the whole row beside them, where no column's name can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail a rule go."""
    return quality.judge(apart(docs)).where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8) the row of smallest id stays.

    Rows are numbered, so rows that share only an id are documents of their own; of rows that are equal in id
    and text one stays. Rows without id come after all others.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("_n"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row")), "numbered")
    found = minhash.classes(rows.select(F.col("_n").alias("doc_id"), "_row.text"), n=5, percent=80)
    of = rows.select("_n", F.col("_row.doc_id").alias("_id")).join(found.select(F.col("doc_id").alias("_n"), "component_id"), "_n")
    least = F.min(F.struct(F.col("_id").isNull(), "_id", "_n"))
    return rows.join(of.groupBy("component_id").agg(least.alias("_f")).select("_f._n"), "_n", "left_semi").select("_row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that started earlier go; n_chars follows the text."""
    out = substring.dedup(apart(docs))
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*[now.get(c, F.col("_row").getField(c).alias(c)) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts, decoded again to check them."""
    return pieces.encode(docs, pieces.vocabulary(), check=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL cannot express MinHash tables or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
