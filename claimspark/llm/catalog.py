"""Queries of the training-data operators and, where SQL can express them, their oracle."""

from __future__ import annotations

from . import (
    byte_bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    filter_audit,
    katz,
    knn_quality,
    periodic_runs,
    quality_rules,
    secret_scan,
    simhash,
    substring_dedup,
    toxicity,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_katz": katz.op4_katz,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_knn": knn_quality.op7_quality_knn,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL = {
    "op8_chat_format": chat_format.ORACLE_OP8,
    "op10_quality_rules": quality_rules.ORACLE_OP10,
    "op12_exact_dedup": exact_dedup.ORACLE_OP12,
    "op13_filter_audit": filter_audit.ORACLE_OP13,
}
