"""The ten queries of the subpackage, and their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, language_id, license_scan, line_dedup, mixing, near_dedup, quality, token_count, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_mixing_sources": mixing.op2_mixing_sources,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_token_counts": token_count.op9_token_counts,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_mixing_sources": mixing.OP2_SQL,
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op7_license_scan": license_scan.OP7_SQL,
    "op10_quality_rules": quality.OP10_SQL,
}
