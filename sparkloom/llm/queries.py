"""The operators over whole tables with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import exactdup, langid, linededup, mixing, neardup, packing, quality, tokencounts, tokens, tokenstore, toxicity
from sparkloom.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_and_verify(read(spark, sf_dir, "documents"), tokens.public_path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(read(spark, sf_dir, "documents"))


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(read(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.tiktoken"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_near_duplicates, op4_token_store, op5_quality, op6_language, op7_line_dedup, op8_exact_duplicates, op9_token_counts, op10_packing)}

ORACLES: dict[str, str] = {
    "op7_line_dedup": linededup.ORACLE_SQL,
    "op8_exact_duplicates": """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) keep_id, count(*) OVER (PARTITION BY text_sha256) group_size,
    doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) kept, text_sha256 FROM t
""",
}
