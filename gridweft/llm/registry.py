"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from gridweft.llm import collocations, conversations, exact_dedup, lm_scoring, mixing, near_dedup, packing, piece_coding, preferences, quality, substring_dedup, topk, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_mix_sources": mixing.query,
    "op3_lm_scores": lm_scoring.query,
    "op4_near_dedup": near_dedup.query,
    "op5_chat_preferences": preferences.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_url_filter": url_filter.query,
    "op8_exact_topk": topk.query,
    "op9_quality_grades": quality.query,
    "op10_pack_sequences": packing.query,
    "op11_piece_coding": piece_coding.query,
    "op12_collocations": collocations.query,
    "op13_conversation_repair": conversations.query,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op2_mix_sources": mixing.ORACLE_SQL,
    "op3_lm_scores": lm_scoring.ORACLE_SQL,
    "op5_chat_preferences": preferences.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_exact_topk": topk.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_conversation_repair": conversations.ORACLE_SQL,
}
