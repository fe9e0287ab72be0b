"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from signalpact.llm.alignment import op12_identity_map_alignment
from signalpact.llm.bpe import op10_segment_tree_bpe
from signalpact.llm.conversations import op13_path_ranked_repair
from signalpact.llm.fingerprints import OP11_SQL, op11_invertible_lookup_fingerprints
from signalpact.llm.near import OP8_SQL, op8_hyperminhash_near_dedup
from signalpact.llm.packing import op6_grouping_genetic_packing
from signalpact.llm.pii import op7_information_sanitiser
from signalpact.llm.rules import op2_isolation_forest_rules
from signalpact.llm.sharding import OP9_SQL, op9_rendezvous_shards
from signalpact.llm.substrings import OP4_SQL, op4_seed_extend_substrings
from signalpact.llm.urls import op1_url_language_models
from signalpact.llm.vafile import OP3_SQL, op3_vector_approximation_topk
from signalpact.llm.weak import op5_weak_label_quality

QUERIES = {
    "op1_url_language_models": op1_url_language_models,
    "op2_isolation_forest_rules": op2_isolation_forest_rules,
    "op3_vector_approximation_topk": op3_vector_approximation_topk,
    "op4_seed_extend_substrings": op4_seed_extend_substrings,
    "op5_weak_label_quality": op5_weak_label_quality,
    "op6_grouping_genetic_packing": op6_grouping_genetic_packing,
    "op7_information_sanitiser": op7_information_sanitiser,
    "op8_hyperminhash_near_dedup": op8_hyperminhash_near_dedup,
    "op9_rendezvous_shards": op9_rendezvous_shards,
    "op10_segment_tree_bpe": op10_segment_tree_bpe,
    "op11_invertible_lookup_fingerprints": op11_invertible_lookup_fingerprints,
    "op12_identity_map_alignment": op12_identity_map_alignment,
    "op13_path_ranked_repair": op13_path_ranked_repair,
}

ORACLE = {
    "op3_vector_approximation_topk": OP3_SQL,
    "op4_seed_extend_substrings": OP4_SQL,
    "op8_hyperminhash_near_dedup": OP8_SQL,
    "op9_rendezvous_shards": OP9_SQL,
    "op11_invertible_lookup_fingerprints": OP11_SQL,
}
