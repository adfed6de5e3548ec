"""Queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from tickloom.llm import conversations, decontaminate, exact_dedup, html_text, importance, licenses, packing, quality, secrets, simhash, substring_dedup, token_counts, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_simhash": simhash.op4_simhash,
    "op5_packing": packing.op5_packing,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_html_text": html_text.op8_html_text,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality": quality.op10_quality,
    "op11_conversations": conversations.op11_conversations,
    "op12_importance": importance.op12_importance,
    "op13_licenses": licenses.op13_licenses,
}
ORACLES = {**url_filter.ORACLE, **secrets.ORACLE, **exact_dedup.ORACLE, **html_text.ORACLE, **quality.ORACLE, **conversations.ORACLE, **importance.ORACLE, **licenses.ORACLE}
