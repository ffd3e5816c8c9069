"""Documents to packed training sequences: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes what the one before it kept, as a table read again from Parquet, and returns the columns
of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.llm import decontam, langid, minhash, packing, substring
from kinforge.llm._store import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain than this go; so do those without a letter.
LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    return langid.recognised(docs.select(*COLUMNS), LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity 0.8 or more over shingles of five words."""
    return minhash.distinct_documents(docs.select(*COLUMNS), k=5, threshold=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that stand elsewhere too; documents left empty go."""
    cut = substring.dedup(docs.select(*COLUMNS), columns=("doc_id", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    cut = cut.filter("n_removed = 0 OR n_removed < n_words")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in packed sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]
#: Several stages have no form in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
