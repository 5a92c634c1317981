"""Queries of this subpackage by name, and the SQL that expresses them where SQL can."""

from __future__ import annotations

from . import conversation_repair, decontamination, embedding_dedup, html_extraction, kd_sharding, language_id, license_scan, quality_classifier, simhash_dedup, source_mixing, spelling_variants, substring_dedup, token_store

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_source_mixing": source_mixing.op8_source_mixing,
    "op9_kd_sharding": kd_sharding.op9_kd_sharding,
    "op10_token_store": token_store.op10_token_store,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_quality_classifier": quality_classifier.op12_quality_classifier,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op3_embedding_dedup": embedding_dedup.ORACLE,
    "op7_license_scan": license_scan.ORACLE,
    "op8_source_mixing": source_mixing.ORACLE,
}
