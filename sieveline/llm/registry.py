"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from sieveline.llm import bpe, exact_dedup, importance, langid, line_quality, lm_score, packing, simhash, token_counts, token_files, topk, url_filter, vector_codes

QUERIES = {
    "op1_topk_search": topk.op1_topk_search,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_bpe_codec": bpe.op3_bpe_codec,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_language_id": langid.op5_language_id,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_token_files": token_files.op8_token_files,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_quality_rules": line_quality.op13_quality_rules,
    "rollup_words_bytes": token_counts.rollup_words_bytes,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": topk.ORACLE,
    "rollup_words_bytes": token_counts.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_quality_rules": line_quality.ORACLE,
}
