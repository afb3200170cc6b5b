"""The text operators' queries and their SQL."""

from __future__ import annotations

from kerbside.llm import ball_tree, best_fit, byte_bpe, divergence, html_extract, line_dedup, minhash_dedup, packing, quality_rules, sharding, suffix_dedup, topk_search, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_packing": packing.op4_packing,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_ball_tree": ball_tree.op11_ball_tree,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_best_fit": best_fit.op13_best_fit,
}

ORACLE_SQL = {"op2_topk_search": topk_search.OP2_SQL, "op7_quality_rules": quality_rules.OP7_SQL, "op11_ball_tree": ball_tree.OP11_SQL, "op12_source_divergence": divergence.OP12_SQL}
