"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from gridlens.llm import decontaminate, embedding_dedup, line_dedup, mixing, ngram_join, permutation_index, ranked_search, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_embedding_near_dedup": embedding_dedup.op2_embedding_near_dedup,
        "op3_url_filters": url_filter.op3_url_filters,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_mixing": mixing.op6_mixing,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_nearest_neighbours": permutation_index.op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.SQL,
        "op2_embedding_near_dedup": embedding_dedup.SQL,
        "op3_url_filters": url_filter.SQL,
        "op7_ngram_join": ngram_join.SQL,
        "op9_line_dedup": line_dedup.SQL,
        "op10_substring_dedup": substring_dedup.SQL,
        "op11_ranked_search": ranked_search.SQL,
        "op12_vector_codes": vector_codes.SQL,
    }
