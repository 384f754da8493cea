"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, exact_dedup, hard_negatives, jaccard_join, language_model, line_dedup, packing, permutation_index, quality_rules, suffix_dedup, token_counts, toxicity, vector_codes

QUERIES = {
    "op1_language_model": language_model.op1_language_model,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_permutation_index": permutation_index.op8_permutation_index,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}
SQL = exact_dedup.SQL | line_dedup.SQL | vector_codes.SQL | hard_negatives.SQL | quality_rules.SQL
