"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from phonoflow.llm import chat, classifier, neighbours, packing, pieces, rules, secret_scan, simhash, site_tree, url_filter

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_nearest_neighbours": neighbours.op5_nearest_neighbours,
    "op6_quality_classifier": classifier.op6_quality_classifier,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_secret_scans": secret_scan.op8_secret_scans,
    "op9_html_extraction": site_tree.op9_html_extraction,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}
ORACLES = {
    "op2_url_filters": url_filter.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op7_quality_rules": rules.ORACLE,
}
