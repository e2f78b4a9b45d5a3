"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, exact_dedup, ngram_join, packing, pii, quality, substring_dedup, tokens, toxicity, unigram

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_unigram_pieces": unigram.query,
    "op3_chat_format": chat.query,
    "op4_toxicity": toxicity.query,
    "op5_quality_rules": quality.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_pii": pii.query,
    "op8_token_files": tokens.query,
    "op9_ngram_join": ngram_join.query,
    "op10_packing": packing.query,
}

ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op3_chat_format": chat.ORACLE}
