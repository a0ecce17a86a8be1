"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup,
substring dedup, packing.

Every stage calls one operator on all that its predecessor kept; the result is
written as Parquet to the shared scratch folder and read again as the next
stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, packing, quality, simhash, substring
from tessera.llm.common import keep, table
from tessera.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the base rules and the threshold table."""
    return quality.filter_quality(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (the one with the largest id)."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints (the one with the smallest id)."""
    return simhash.keep_one_per_component(docs, shingle=3, radius=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and sentences that an earlier document has; n_chars follows the text."""
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(spark, stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs


#: No SQL can tell the tokenizer's ids or the fingerprints; tests compare run() with a brute-force version.
ORACLE_SQL = None
