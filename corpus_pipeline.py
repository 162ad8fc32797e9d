"""Training-data pipeline over documents: each stage works on all that its predecessor kept.

Every stage but the last returns the columns of documents. Defined cases are those of the operators: null and empty
texts fail the quality rules, so the later stages see texts only; rows that share an id are judged one by one; of a
group of near-duplicates the row with the smallest id stays (of equal ids the text with the smallest hash, and of equal
rows one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgauge.llm import bpe, decision_list, decontaminate, jaccard_join, pii_crf
from crawlgauge.llm.common import arrow_batches, materialize, table

# Near-duplicates of the pipeline: five-word shingles, similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row as one struct, which no column of an operator can clash with."""
    return docs.select("doc_id", "text", F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from the labels."""
    arrow_batches(spark)
    rules = decision_list.learn_from(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(_whole(docs), rules).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without words are no duplicates."""
    arrow_batches(spark)
    return jaccard_join.one_of_each(docs, NUM, DEN, SHINGLE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    judged = decontaminate.contamination(_whole(docs), table(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select("_row.*")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data and credentials replaced by their kinds; n_chars follows the text."""
    arrow_batches(spark)
    redacted = docs.withColumn("text", pii_crf.redact(F.col("text")))
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return redacted


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every remaining text."""
    arrow_batches(spark)
    encoded = docs.select("doc_id", bpe.encode(F.col("text")).alias("ids"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("pii", without_pii),
    ("byte_bpe", tokens),
]

# Learned rules and library tokenizers are not SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
