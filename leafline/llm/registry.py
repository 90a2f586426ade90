"""The corpus operators' queries and SQL."""

from __future__ import annotations

from leafline.llm import decontaminate, html_text, mixing, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, token_counts, token_files

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_sharding": sharding.query,
    "op3_html_text": html_text.query,
    "op4_decontaminate": decontaminate.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_token_counts": token_counts.query,
    "op7_mixing": mixing.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_near_dedup": near_dedup.query,
    "op10_token_files": token_files.query,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op9_near_dedup": near_dedup.SQL,
}
