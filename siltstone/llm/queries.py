"""The registered queries of this subpackage, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import clusters, fill_middle, html_text, lm_score, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, sharding, suffix_dedup, topk

QUERIES = {
    "op1_hash_tree_sharding": sharding.query,
    "op2_rule_ensemble_quality": quality_classifier.query,
    "op3_hyperminhash_near_dedup": near_dedup.query,
    "op4_prefix_free_repeats": suffix_dedup.query,
    "op5_crf_pii": pii.query,
    "op6_tiered_packing": packing.query,
    "op7_html_layout": html_text.query,
    "op8_decision_list_rules": quality_rules.query,
    "op9_raked_mixing": mixing.query,
    "op10_ball_tree_topk": topk.query,
    "op11_hamerly_clusters": clusters.query,
    "op12_fill_in_middle": fill_middle.query,
    "op13_bloom_lm_score": lm_score.query,
}

ORACLES = {"op3_hyperminhash_near_dedup": near_dedup.SQL, "op10_ball_tree_topk": topk.SQL, "op11_hamerly_clusters": clusters.SQL, "op12_fill_in_middle": fill_middle.SQL}
