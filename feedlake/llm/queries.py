"""The training-data queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from feedlake.llm import exact_search, exact_text, html_text, line_dedup, mixing, near_text, near_vectors, packing, quality, resampling, spelling, token_files, url_filter

QUERIES = {
    "op1_wrapper_text": html_text.op1_wrapper_text,
    "op2_exact_topk": exact_search.op2_exact_topk,
    "op3_byte_planes": token_files.op3_byte_planes,
    "op4_lsh_forest": near_text.op4_lsh_forest,
    "op5_curriculum_mix": mixing.op5_curriculum_mix,
    "op6_url_ratio": url_filter.op6_url_ratio,
    "op7_best_fit": packing.op7_best_fit,
    "op8_random_indexing": quality.op8_random_indexing,
    "op9_cap_filters": near_vectors.op9_cap_filters,
    "op10_line_windows": line_dedup.op10_line_windows,
    "op11_chunk_recipes": exact_text.op11_chunk_recipes,
    "op12_deletion_keys": spelling.op12_deletion_keys,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op2_exact_topk": exact_search.OP2_SQL,
    "op5_curriculum_mix": mixing.OP5_SQL,
    "op10_line_windows": line_dedup.OP10_SQL,
    "op11_chunk_recipes": exact_text.OP11_SQL,
}
