"""A corpus pipeline of five of the training-data operators.

Every stage takes all rows that the one before kept and, but for the last,
returns rows with the columns of ``documents`` and any others that came along,
whatever those are called. A null text counts as an empty one. An empty table
passes through all stages as one. Texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weightscope.llm import bpe, decontaminate, pii, quality, simhash
from weightscope.llm.common import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go, as do those under 20 words; a null or unknown
    language takes the rules of the text's script; equal rows share their lot.
    """
    return quality.keep(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The least doc_id stays (nulls last), of equal ones the least text, of equal
    rows any one. Texts without words are copies of each other.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    A document that they make up a twentieth of goes, from others they are cut.
    Null texts and benchmark items without words are in nothing.
    """
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. All rows stay; a null text stays null."""
    return pii.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the round trip: a row a row, no ids for a null text."""
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", byte_bpe),
]

#: SQL has neither the tokenizers nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
