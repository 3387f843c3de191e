"""Queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from . import chat_format, decontamination, license_scan, lm_scoring, nearest_neighbours, ngram_jaccard, packing, quality_classifier, substring_dedup, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_ngram_jaccard": ngram_jaccard.op5_ngram_jaccard,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_packing": packing.op7_packing,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_nearest_neighbours": nearest_neighbours.op9_nearest_neighbours,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLES = {
    "op1_chat_format": chat_format.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op5_ngram_jaccard": ngram_jaccard.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
}
