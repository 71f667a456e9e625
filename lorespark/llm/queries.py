"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import chat, decontam, language_id, media, mixing, near_dup, quality, token_counts, toxicity, turns, url_filters, vector_codes, warc_zip

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_chat_repair": chat.query,
    "op3_mix_sources": mixing.query,
    "op4_quality": quality.query,
    "op5_near_dup": near_dup.query,
    "op6_media": media.query,
    "op7_decontaminate": decontam.query,
    "op8_toxicity": toxicity.query,
    "op9_warc": warc_zip.query,
    "op10_url_filters": url_filters.query,
    "op11_language_id": language_id.query,
    "op12_turns": turns.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLE_SQL = {
    "op3_mix_sources": mixing.SQL,
    "op7_decontaminate": decontam.SQL,
    "op9_warc": warc_zip.SQL,
    "op10_url_filters": url_filters.SQL,
    "op12_turns": turns.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
