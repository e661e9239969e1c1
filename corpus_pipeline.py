"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, mixing, token output.

Each stage takes all that its predecessor kept, written as Parquet and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plait.llm import decontam, langid, mixing, neardup, tokens
from plait.plans.staging import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go, null and empty texts among them; repeated rows are judged each; no rows give none."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, that of the least id.

    SimHash of the shingles proposes copies, whole sets decide, and an exact way finds those that SimHash tells apart.  Null ids come last; texts without words are one group; no rows give none.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages leave the texts; documents that are mostly such passages go.

    Null and empty texts stay as they are; an empty benchmark changes nothing; no rows give none.
    """
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; null sources are one, texts without words may go; no rows give none."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files are written and read back: doc_id, start, n_tokens, ids_crc32 of each document.

    Null ids come first, repeated rows are encoded each, a null text is the end id alone; no rows give none.
    """
    return tokens.read(tokens.write(docs, tokens.vocabulary_path()), tokens.crc32_of, "ids_crc32", "long")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_ids),
]

#: SQL has no tokenizer and no naive Bayes over hashed n-grams.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"stage{k}")
    return docs
