"""The registered queries of the operators in this subpackage: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import ann, bpe, decontam, fim, html, jaccard, langid, licenses, merkle, oracles, simhash, tokens, toxicity, warc
from seqloom.llm.common import crc_mod, table

BYTE_BPE = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(ann.is_query())
    return ann.search(ann.build(rows, queries=asked), asked, 20)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), TOKEN_LIMIT)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "llr")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.learn(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents")).drop("fp")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    suspect = F.coalesce(crc_mod("doc_id", 3) == 0, F.lit(False))
    return merkle.verify(table(spark, sf_dir, "documents"), suspect)


QUERIES = {f.__name__: f for f in (op1_additive_quantisation, op2_token_counts, op3_decontamination, op4_license_scan, op5_jaccard_join, op6_toxicity, op7_language_id, op8_bpe, op9_html_text, op10_warc, op11_simhash, op12_fill_in_middle, op13_merkle)}
ORACLE_SQL: dict[str, str] = {"op5_jaccard_join": oracles.JACCARD, "op10_warc": oracles.WARC, "op4_license_scan": licenses.oracle(), "op12_fill_in_middle": oracles.FILL_IN_MIDDLE, "op13_merkle": oracles.MERKLE}
