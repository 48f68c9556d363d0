"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from attestra.llm import bpe, chat, decontaminate, html, jaccard, langid, licenses, pii, quality, separators

QUERIES = {
    "op1_byte_bpe": bpe.query,
    "op2_token_counts": separators.query,
    "op3_chat_format": chat.query,
    "op4_language_id": langid.query,
    "op5_html_extraction": html.query,
    "op6_license_scan": licenses.query,
    "op7_ngram_jaccard": jaccard.query,
    "op8_pii": pii.query,
    "op9_quality_rules": quality.query,
    "op10_decontamination": decontaminate.query,
}

ORACLES = {
    "op3_chat_format": chat.oracle(),
    "op4_language_id": langid.oracle(),
    "op6_license_scan": licenses.oracle(),
    "op7_ngram_jaccard": jaccard.oracle(),
    "op10_decontamination": decontaminate.oracle(),
}
