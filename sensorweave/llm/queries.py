"""The op queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorweave.llm import conversation_repair, decontaminate, digests, langid, licenses, near_dups, oracles, quality, sentencepiece_codec, token_counts, toxicity, url_rules, vector_codes, warc

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit_lexicon(documents, table(spark, sf_dir, "labels")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.PieceModel.load(public_tokenizers.path(PIECE_MODEL))
    return sentencepiece_codec.token_digests(table(spark, sf_dir, "documents"), model)


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=0.85)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit_quality(documents, table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_with_next(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit_language(documents))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.ByteVocabulary.load(public_tokenizers.path(BYTE_VOCABULARY)))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.product_codes(table(spark, sf_dir, "embeddings"))


def license_base_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op2_licenses`` returns of the fixed phrases alone, which SQL can express."""
    return op2_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_fixed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op5_url_rules`` returns of the fixed rules alone."""
    return op5_url_rules(spark, sf_dir).select("page_id", "host", "path", "rule")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op8_fingerprints`` returns of the texts themselves."""
    return op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_near_dups": op4_near_dups,
    "op5_url_rules": op5_url_rules,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_fingerprints": op8_fingerprints,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_token_counts": op11_token_counts,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
    "license_base_labels": license_base_labels,
    "url_fixed_rules": url_fixed_rules,
    "edited_texts": edited_texts,
}
ORACLES: dict[str, str] = {
    "op4_near_dups": oracles.OP4,
    "op7_decontaminate": oracles.OP7,
    "op9_warc": oracles.OP9,
    "op12_conversation_repair": oracles.OP12,
    "op13_vector_codes": oracles.OP13,
    "license_base_labels": oracles.LICENSE_BASE,
    "url_fixed_rules": oracles.URL_RULES,
    "edited_texts": oracles.EDITED,
}
