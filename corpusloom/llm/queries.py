"""The queries of this package: opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import conversations, cws, hyperplane, licenses, mixing, negatives, pieces, quality, simhash, substring, tokenids, toxicity, urls

QUERIES = {
    "op1_simhash_dedup": simhash.op1,
    "op2_url_filter": urls.op2,
    "op3_huffman_tokens": tokenids.op3,
    "op4_license_scan": licenses.op4,
    "op5_quality": quality.op5,
    "op6_hyperplane_dedup": hyperplane.op6,
    "op7_mixing": mixing.op7,
    "op8_sentencepiece": pieces.op8,
    "op9_substring_dedup": substring.op9,
    "op10_cws_fingerprints": cws.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_toxicity": toxicity.op12,
    "op13_conversation_repair": conversations.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": urls.SQL,
    "op6_hyperplane_dedup": hyperplane.SQL,
    "op7_mixing": mixing.SQL,
    "op9_substring_dedup": substring.SQL,
    "op11_hard_negatives": negatives.SQL,
}
