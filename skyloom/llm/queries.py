"""The thin queries of this subpackage and their DuckDB SQL, by the names that ``__spark_entry__`` registers."""

from __future__ import annotations

from skyloom.llm import benchmark_leaks, byte_bpe, language_id, license_scan, lm_score, near_dup, quality_classifier, quality_rules, sharding, warc

QUERIES = {
    "op1_benchmark_leaks": benchmark_leaks.query,
    "op2_lm_score": lm_score.query,
    "op3_near_dup": near_dup.query,
    "op4_language_id": language_id.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_license_scan": license_scan.query,
    "op7_quality_rules": quality_rules.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_warc": warc.query,
    "op10_sharding": sharding.query,
}
SQL = {
    "op1_benchmark_leaks": benchmark_leaks.SQL,
    "op3_near_dup": near_dup.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op9_warc": warc.SQL,
}
