"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroids, chat, decontaminate, linededup, mixing, paragraphs, pii, quality, simhash, spelling, suffixes, tokencounts, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_chat_format": chat.op5_chat_format,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_substring_dedup": paragraphs.op7_substring_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_pii": pii.op9_pii,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_spelling": spelling.op11_spelling,
    "op12_centroids": centroids.op12_centroids,
    "op13_token_counts": tokencounts.op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.OP3_SQL,
    "op4_quality": quality.OP4_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op6_line_dedup": linededup.OP6_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op12_centroids": centroids.OP12_SQL,
}
