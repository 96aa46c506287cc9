"""The registered query and, where SQL can express it, the oracle of each operator."""

from tallyreef.llm import byte_bpe, conversation_repair, cross_polytope, fill_middle, language_id, mixing, near_dedup, packed_ids, quality_model, quality_rules, secret_scan, site_tree, topk

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_model": quality_model.op2_quality_model,
    "op3_site_tree": site_tree.op3_site_tree,
    "op4_packed_ids": packed_ids.op4_packed_ids,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_top_k": topk.op10_top_k,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_cross_polytope": cross_polytope.op13_cross_polytope,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op10_top_k": topk.ORACLE_SQL,
    "op12_fill_in_middle": fill_middle.ORACLE_SQL,
}
