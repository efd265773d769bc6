"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontamination, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_packing": packing.op8_packing,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op4_chat_format": chat_format.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op6_ngram_join": ngram_join.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op9_url_filter": url_filter.SQL,
}
