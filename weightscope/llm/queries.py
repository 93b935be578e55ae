"""The queries that apply each operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightscope.llm import bpe, chat, decontaminate, html_extract, pii, quality, sharding, simhash, token_counts, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, each distinct content encoded once."""
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality features and verdict of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"), "quality.*")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.summary(pii.detect(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one made of control strings."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.PROBE).alias("text")
    )
    return chat.read_back(chat.format_conversations(rows.unionByName(probe)))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE there and back of every document."""
    return bpe.encode_and_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), texts=False)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.summary(decontaminate.find_leaks(docs, _read(spark, sf_dir, "benchmark")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_token_counts,
        op3_html_extract,
        op4_fertility,
        op5_sharding,
        op6_pii,
        op7_chat_format,
        op8_byte_bpe,
        op9_warc,
        op10_decontaminate,
    )
}
ORACLE_SQL: dict[str, str] = {"op5_sharding": sharding.ORACLE, "op7_chat_format": chat.ORACLE, "op9_warc": warc.ORACLE}
