"""A training-data pipeline: each stage takes what the one before kept, and all but the last return whole documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, decontam, jaccard, langid, toxicity
from seqloom.llm.common import bounded_batches, crc_mod, materialize, table


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no clear language, go."""
    bounded_batches(spark)
    return langid.clean(docs, langid.learn(docs, crc_mod("doc_id", 4) != 2))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, directly or over others, the one with the least id stays."""
    bounded_batches(spark)
    return jaccard.representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as counts and digests."""
    bounded_batches(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", keep_civil),
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: Models and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
