"""Registered queries of the subpackage and the SQL they are compared with."""

from __future__ import annotations

from ebbtide.llm import chat, chunked_bpe, classifier, decontamination, lm_scoring, pii, prefix_trie, quality_rules, repair, sharding, simhash, token_counts, toxicity

QUERIES = {
    "op1_log_bilinear": lm_scoring.op1_log_bilinear,
    "op2_latent_retrieval": decontamination.op2_latent_retrieval,
    "op3_prefix_target": chat.op3_prefix_target,
    "op4_boosted_rules": quality_rules.op4_boosted_rules,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_covering_simhash": simhash.op6_covering_simhash,
    "op7_chunk_reuse": chunked_bpe.op7_chunk_reuse,
    "op8_weak_label_classifier": classifier.op8_weak_label_classifier,
    "op9_feistel_pseudonyms": pii.op9_feistel_pseudonyms,
    "op10_rendezvous_sharding": sharding.op10_rendezvous_sharding,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_counterfactual_toxicity": toxicity.op12_counterfactual_toxicity,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op3_prefix_target": chat.SQL,
    "op10_rendezvous_sharding": sharding.SQL,
    "op11_structure_repair": repair.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
