"""Corpus pipeline: quality rules, near copies, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back as the next one's ``docs``. All but
the last return the columns of ``docs``. Stages inherit the handling of nulls, empty texts and repeated rows from their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldwise.llm import decontamination, mixing, ngram_join, quality_rules, token_output
from fieldwise.llm.store import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Accepted documents, without their failing lines."""
    return quality_rules.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.drop_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of the token files: doc_id, start, n_tokens, ids_crc32."""
    return token_output.encode_and_read(docs)


STAGES = [("quality_rules", quality), ("near_copies", near_copies), ("decontamination", decontaminate), ("mixing", mix), ("token_output", tokens)]

#: Fingerprint searches, hashed draws and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
