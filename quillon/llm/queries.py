"""Queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from . import ann, chat_format, fingerprints, language_id, line_dedup, mixing, ngram_join, packing, token_alignment, token_counts, toxicity, turn_reassembly, url_filter

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_additive_ann": ann.op5_additive_ann,
    "op6_language_id": language_id.op6_language_id,
    "op7_source_mix": mixing.op7_source_mix,
    "op8_url_filter": url_filter.op8_url_filter,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op9_token_counts": token_counts.op9_token_counts,
    "op11_turn_reassembly": turn_reassembly.op11_turn_reassembly,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES = {"op1_ngram_join": ngram_join.OP1_SQL, "op2_chat_format": chat_format.OP2_SQL, "op7_source_mix": mixing.OP7_SQL, "op8_url_filter": url_filter.OP8_SQL, "op11_turn_reassembly": turn_reassembly.OP11_SQL}
