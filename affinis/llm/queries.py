"""Registered queries of the subpackage: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from affinis.llm import (decontamination, fingerprints, html_blocks, importance, mixing, near_dup, prefix_trie, quality,
                         secrets, substring_dedup, token_counts, url_filters, warc)

LLM_REGISTRY = {
    "op1_secret_scans": (secrets.op1_secret_scans, secrets.OP1_SQL),
    "op2_fingerprints": (fingerprints.op2_fingerprints, None),
    "op3_decontamination": (decontamination.op3_decontamination, decontamination.OP3_SQL),
    "op4_warc": (warc.op4_warc, warc.OP4_SQL),
    "op5_quality_classifier": (quality.op5_quality_classifier, None),
    "op6_mixing": (mixing.op6_mixing, mixing.OP6_SQL),
    "op7_minhash_neardup": (near_dup.op7_minhash_neardup, near_dup.OP7_SQL),
    "op8_html_blocks": (html_blocks.op8_html_blocks, None),
    "op9_token_counts": (token_counts.op9_token_counts, None),
    "op10_substring_dedup": (substring_dedup.op10_substring_dedup, substring_dedup.OP10_SQL),
    "op11_url_filters": (url_filters.op11_url_filters, url_filters.OP11_SQL),
    "op12_prefix_trie": (prefix_trie.op12_prefix_trie, prefix_trie.OP12_SQL),
    "op13_importance": (importance.op13_importance, importance.OP13_SQL),
}
