"""A corpus-cleaning pipeline: each stage is one operator applied to what its predecessor kept.

Every stage takes (session, documents, folder) and returns a DataFrame that is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stagewise.llm import lines, packing, quality, secrets, simhash
from stagewise.llm.common import stored
from stagewise.llm.queries import (
    GOOD,
    LINE_CHARS,
    LINE_EDITS,
    PACKED_TOKENS,
    SIMHASH_BITS,
    SIMHASH_WORDS,
    tokenizer_path,
)


def drop_low_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"), GOOD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return lines.dedup_lines(docs, LINE_EDITS, LINE_CHARS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.one_of_each(docs, SIMHASH_WORDS, SIMHASH_BITS)


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), PACKED_TOKENS)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_tokens),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each result stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
