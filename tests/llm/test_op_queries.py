"""The op queries over the smallest tables: contract columns, one row per document or page, and their SQL."""

import pytest

from sensorweave.llm import queries as Q
from tests.oracle import connect, rows_of, rows_of_sql

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_near_dups": "doc_id n_shingles component_id kept",
    "op5_url_rules": "page_id host path rule verdict",
    "op6_quality": "doc_id held_out score predicted",
    "op7_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_language": "doc_id held_out lang_pred score",
    "op11_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op12_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_vector_codes": "vec_id code error label_error codebooks_sha256",
    "license_base_labels": "doc_id n_words n_base first_word last_word base_labels",
    "url_fixed_rules": "page_id host path rule",
    "edited_texts": "doc_id n_chars edited_sha256",
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_op_query(spark, sf_dir, name):
    found = Q.QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    columns, rows = rows_of(found)
    key = COLUMNS[name].split()[0]
    source = {"page_id": "pages", "doc_id": "documents", "conv_id": "conversations", "vec_id": "embeddings"}[key]
    given = Q.table(spark, sf_dir, source).select(key)
    assert len(rows) == (given.distinct() if key == "conv_id" else given).count()
    if name in Q.ORACLES:
        assert (columns, rows) == rows_of_sql(connect(sf_dir), Q.ORACLES[name])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    documents = Q.table(spark, sf_dir, "documents")
    docs, ids = documents, {r["doc_id"] for r in documents.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        assert found.columns == documents.columns
        left = {r["doc_id"] for r in found.select("doc_id").collect()}
        assert left and left <= ids
        docs, ids = found, left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == ids
