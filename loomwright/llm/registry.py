"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from loomwright.llm import chat, language, licenses, matroska, mixing, mtree, near, packing, tokens, toxicity

QUERIES = {
    "op1_minhash_odd_sketches": near.op1_minhash_odd_sketches,
    "op2_language_id": language.op2_language_id,
    "op3_matroska_packets": matroska.op3_matroska_packets,
    "op4_raked_mixture": mixing.op4_raked_mixture,
    "op5_license_set_join": licenses.op5_license_set_join,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_toxicity_mil": toxicity.op7_toxicity_mil,
    "op8_mtree_top_k": mtree.op8_mtree_top_k,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_prefix_target_chat": chat.op10_prefix_target_chat,
}
ORACLES: dict[str, str] = {
    "op1_minhash_odd_sketches": near.ORACLE,
    "op4_raked_mixture": mixing.ORACLE,
    "op5_license_set_join": licenses.ORACLE,
    "op8_mtree_top_k": mtree.ORACLE,
    "op10_prefix_target_chat": chat.ORACLE,
}
